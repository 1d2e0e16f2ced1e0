"""Dataset engineering queries: normalisers, tokens, hashes, splits, deduplication, quotas, decontamination, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.functions import text as T
from sievework.functions.text import split_name, trimmed_lower
from sievework.operators import selection as S
from sievework.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _docs(spark, d):
    return table(spark, d, "documents")


def _ex(spark, d):
    return table(spark, d, "examples")


_C = r"trim(regexp_replace({0}, '[ \t\n\r\f]+', ' ', 'g'))"
_TEXT = "SELECT doc_id, md5({0}) AS digest FROM documents WHERE text IS NOT NULL"
_NORM_GOLD = "regexp_replace(regexp_replace(" + _C.format("lower({0})") + ", '^[\"''«“]+', ''), '[\"''»”.!?]+$', '')"
_NORM_WEB = _C.format("regexp_replace(lower({0}), '\\p{{Nd}}', '0', 'g')")
_NORM_GUARD = "trim(regexp_replace(regexp_replace(lower({0}), '\\p{{Nd}}', '0', 'g'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_NORM_AGENT = _C.format("lower(regexp_replace(replace({0}, '\\\"', '\"'), '\\p{{Nd}}', '0', 'g'))")


def _norm(spark, d, f):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(f(F.col("text"))).alias("digest"))


@query(r"""WITH n AS (SELECT doc_id, lang, nfc_normalize(text) AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, md5(trim(CASE WHEN lang IN ('fa', 'ar') THEN regexp_replace(translate(translate(regexp_replace(t, '[\x{064B}-\x{0652}\x{0670}\x{0640}]', '', 'g'),
      '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), 'يك', 'یک'), '[ \t]+', ' ', 'g') ELSE t END)) AS digest FROM n""")
def f01_normalize(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(T.normalize(F.col("text"), F.col("lang"))).alias("digest"))


@query(_TEXT.format("translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"))
def f02_ascii_digits(spark, d):
    return _norm(spark, d, T.ascii_digits)


@query(_TEXT.format(r"translate(regexp_replace(lower(text), '\p{M}', '', 'g'), 'يىكۀةأإآٱ', 'ییکههاااا')"))
def f03_fold_letters(spark, d):
    return _norm(spark, d, T.fold_letters)


@query(_TEXT.format(_NORM_GOLD.format("text")))
def f04_norm_gold(spark, d):
    return _norm(spark, d, T.norm_gold)


@query(_TEXT.format(_NORM_WEB.format("text")))
def f05_norm_web(spark, d):
    return _norm(spark, d, T.norm_web)


@query(_TEXT.format(_NORM_GUARD.format("text")))
def f06_norm_guard(spark, d):
    return _norm(spark, d, T.norm_guard)


@query(_TEXT.format(_NORM_AGENT.format("text")))
def f07_norm_agent(spark, d):
    return _norm(spark, d, T.norm_agent)


@query(f"""SELECT row_id, CASE WHEN length(n) >= 8 THEN substr(sha256(n), 1, 24) END AS key FROM (SELECT row_id, {_C.format("lower(question)")} AS n FROM examples)""")
def f08_overlap_key(spark, d):
    return _ex(spark, d).select("row_id", T.overlap_key(F.col("question")).alias("key"))


_TOK = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\r\f]')"


@query(f"""WITH t AS (SELECT doc_id, {_TOK.format(_NORM_WEB.format("text"))} AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN len(t) >= 3 THEN len(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) ELSE 0 END AS n_shingles FROM t""")
def f09_shingles(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.size(T.shingles(T.tokens(T.norm_web(F.col("text"))))).cast("bigint").alias("n_shingles"))


@query(f"SELECT doc_id, len(list_distinct({_TOK.format(_NORM_AGENT.format('text'))})) AS n_tokens FROM documents WHERE text IS NOT NULL")
def f10_token_set(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.size(F.array_distinct(T.tokens(T.norm_agent(F.col("text"))))).cast("bigint").alias("n_tokens"))


_LINES = "regexp_split_to_array(text, '[\\r\\n]+')"
_SEG = f"""SELECT DISTINCT doc_id, md5(seg) AS key FROM (
    SELECT doc_id, 's:' || s AS seg FROM (SELECT doc_id, unnest(list_append(list_transform({_LINES}, lambda s: {_NORM_GOLD.format("s")}), {_NORM_GOLD.format("text")})) AS s FROM documents WHERE text IS NOT NULL) WHERE length(s) >= 8
    UNION ALL SELECT doc_id, 'p:' || substr(n, 1, 200) FROM (SELECT doc_id, {_NORM_GOLD.format("text")} AS n FROM documents WHERE text IS NOT NULL) WHERE length(n) >= 200)"""


@query(_SEG)
def f11_segments(spark, d):
    return S.segments(_docs(spark, d), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(r"""SELECT doc_id, CASE WHEN text IS NULL THEN 'en'
    WHEN len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) > length(text) * 0.2 AND len(regexp_extract_all(text, '[پچژگکی]')) > len(regexp_extract_all(text, '[ةىيك]')) THEN 'fa'
    WHEN len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) > length(text) * 0.2 THEN 'ar' WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') THEN 'hi' WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'ja'
    WHEN regexp_matches(text, '[\x{AC00}-\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'zh' WHEN len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) > length(text) * 0.2 THEN 'ru'
    WHEN regexp_matches(text, '[\x{0E00}-\x{0E7F}]') THEN 'th'
    WHEN len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w IN ('der', 'die', 'das', 'und', 'nicht', 'ist', 'ein', 'eine', 'mit', 'für'))) >= 2 THEN 'de' ELSE 'en' END AS guess FROM documents""")
def f12_guess_language(spark, d):
    return _docs(spark, d).select("doc_id", T.guess_language(F.col("text")).alias("guess"))


@query("SELECT row_id, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS entropy FROM (SELECT row_id, list_transform(probs, lambda x: x / list_sum(probs)) AS p FROM examples WHERE probs IS NOT NULL)")
def f27_entropy(spark, d):
    return _ex(spark, d).where("probs IS NOT NULL").select("row_id", F.round(A.entropy(A.renormalise(F.col("probs"))), 6).alias("entropy"))


@query("SELECT row_id, round(list_sum(list_transform(p, lambda x, i: x * (i - 1))), 6) AS level FROM (SELECT row_id, list_transform(probs, lambda x: x / list_sum(probs)) AS p FROM examples WHERE probs IS NOT NULL AND kind = 'score')")
def f21_expected_level(spark, d):
    return _ex(spark, d).where("probs IS NOT NULL AND kind = 'score'").select("row_id", F.round(A.expected_level(A.renormalise(F.col("probs"))), 6).alias("level"))


@query("""SELECT row_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM (SELECT row_id, list_transform(probs, lambda x: exp((x - list_max(probs)) / 0.45)) AS e FROM examples WHERE probs IS NOT NULL)""")
def f19_softmax(spark, d):
    return _ex(spark, d).where("probs IS NOT NULL").select("row_id", F.transform(A.softmax(F.col("probs"), 0.45), lambda x: F.round(x, 6)).alias("p"))


@query("""SELECT row_id, CASE WHEN len(probs) = 1 THEN 1.0 ELSE round(least(1.0, greatest(0.0, (len(probs) * list_max(probs) - 1) / (len(probs) - 1))), 9) END AS confidence FROM examples WHERE probs IS NOT NULL""")
def f20_confidence(spark, d):
    return _ex(spark, d).where("probs IS NOT NULL").select("row_id", F.round(A.confidence(F.col("probs")), 9).alias("confidence"))


@query("""WITH g AS (SELECT row_id, [0.3, 0.8] AS gap, list_sum(list_transform(probs, lambda x, i: x * (i - 1))) AS s FROM examples WHERE probs IS NOT NULL AND kind = 'score' AND n_choices >= 3),
    h AS (SELECT row_id, s, list_transform(gap, lambda x: greatest(x, 0) + ln(1 + exp(-abs(x))) + 1e-3) AS g FROM g),
    a AS (SELECT row_id, [1.0, 1 / (1 + exp(-(s - (g[1] - list_sum(g) / 2)))), 1 / (1 + exp(-(s - (g[1] + g[2] - list_sum(g) / 2)))), 0.0] AS above FROM h),
    p AS (SELECT row_id, list_transform([1, 2, 3], lambda i: greatest(1e-7, above[i] - above[i + 1])) AS p FROM a) SELECT row_id, list_transform(p, lambda x: round(x / list_sum(p), 6)) AS p FROM p""")
def f22_ordinal(spark, d):
    rows = _ex(spark, d).where("probs IS NOT NULL AND kind = 'score' AND n_choices >= 3")
    p = A.ordinal(A.expected_level(F.col("probs")), F.array(F.lit(0.3), F.lit(0.8)))
    return rows.select("row_id", F.transform(p, lambda x: F.round(x, 6)).alias("p"))


@query("""SELECT row_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM (SELECT row_id, list_transform(probs, lambda x: exp((ln(greatest(x, 1e-12)) - ln(greatest(list_max(probs), 1e-12))) / 1.7)) AS e FROM examples WHERE probs IS NOT NULL)""")
def f23_temper(spark, d):
    return _ex(spark, d).where("probs IS NOT NULL").select("row_id", F.transform(A.temper(F.col("probs"), 1.7), lambda x: F.round(x, 6)).alias("p"))


@query("SELECT row_id, list_transform(range(n_choices), lambda i: round(CASE WHEN n_choices = 1 THEN 1.0 WHEN i = gold THEN 0.92 ELSE 0.08 / (n_choices - 1) END, 6)) AS p FROM examples")
def f24_smooth_labels(spark, d):
    return _ex(spark, d).select("row_id", F.transform(A.smooth_labels(F.col("n_choices"), F.col("gold")), lambda x: F.round(x, 6)).alias("p"))


@query("""SELECT row_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM (SELECT row_id, list_transform(probs, lambda x: greatest(x, 1e-4)) AS e FROM examples WHERE probs IS NOT NULL AND kind <> 'rank' AND list_sum(probs) BETWEEN 0.9 AND 1.1)""")
def f26_floor_probs(spark, d):
    rows = _ex(spark, d).where("probs IS NOT NULL AND kind <> 'rank'").withColumn("q", A.floor_probs(F.col("probs"))).where("q IS NOT NULL")
    return rows.select("row_id", F.transform("q", lambda x: F.round(x, 6)).alias("p"))


@query("""WITH s AS (SELECT row_id, list_transform(probs, lambda x: exp((x - list_max(probs)) / 0.45)) AS e FROM examples WHERE probs IS NOT NULL),
    f AS (SELECT row_id, list_transform(e, lambda x: greatest(x / list_sum(e), 0.004)) AS e FROM s) SELECT row_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM f""")
def f45_soft_targets(spark, d):
    return _ex(spark, d).where("probs IS NOT NULL").select("row_id", F.transform(A.soft_targets(F.col("probs")), lambda x: F.round(x, 6)).alias("p"))


@query("SELECT row_id, substr(sha1(concat_ws(chr(31), state, question, array_to_string(choices, chr(31)))), 1, 16) AS sid FROM examples")
def f28_row_id(spark, d):
    return _ex(spark, d).select("row_id", T.row_id(F.col("state"), F.col("question"), F.array_join("choices", "\x1f")).alias("sid"))


_HEX = "('0x' || substr({0}, 1, 8))::BIGINT"


@query(f"SELECT row_id, round({_HEX.format('md5(' + chr(39) + 'web:' + chr(39) + ' || question)')} / 4294967296.0, 6) AS bucket FROM examples")
def f30_md5_bucket(spark, d):
    return _ex(spark, d).select("row_id", F.round(T.md5_bucket("web", F.col("question")), 6).alias("bucket"))


@query(f"SELECT row_id, {_HEX.format('sha1(id)')} / 4294967295.0 < 0.05 AS held FROM examples")
def f31_holdout(spark, d):
    return _ex(spark, d).select("row_id", T.held_out(F.col("id"), 0.05).alias("held"))


@query(f"SELECT row_id, {_HEX.format('sha1(group_id)')} % 100 AS bucket FROM examples WHERE group_id IS NOT NULL")
def f32_group_split(spark, d):
    return _ex(spark, d).where("group_id IS NOT NULL").select("row_id", T.group_bucket(F.col("group_id")).alias("bucket"))


@query("SELECT row_id, json_valid(regexp_extract(state, '(?s)(\\{.*\\})', 1)) AND regexp_extract(state, '(?s)(\\{.*\\})', 1) <> '' AS ok FROM examples WHERE state IS NOT NULL")
def f33_lenient_json(spark, d):
    return _ex(spark, d).where("state IS NOT NULL").select("row_id", T.lenient_json(F.col("state")).isNotNull().alias("ok"))


@query("SELECT row_id, CASE WHEN json_valid(state) AND json_type(state) = 'OBJECT' THEN json_exists(state, '$.claim') AND json_exists(state, '$.source_text') ELSE true END AS fits FROM examples WHERE state IS NOT NULL AND trim(state) <> ''")
def f34_required_keys(spark, d):
    return _ex(spark, d).where("state IS NOT NULL AND trim(state) <> ''").select("row_id", T.has_keys(F.col("state"), ["claim", "source_text"]).alias("fits"))


@query("SELECT count(*) AS n, sum(gold)::BIGINT AS gold FROM examples WHERE state IS NOT NULL AND probs IS NOT NULL AND kind IN ('choose', 'score', 'verify', 'rank') AND len(probs) = len(choices) AND gold BETWEEN 0 AND len(choices) - 1")
def p02_valid_rows(spark, d):
    ok = "state IS NOT NULL AND probs IS NOT NULL AND kind IN ('choose', 'score', 'verify', 'rank') AND size(probs) = size(choices) AND gold BETWEEN 0 AND size(choices) - 1"
    return _ex(spark, d).where(ok).agg(F.count(F.lit(1)).alias("n"), F.sum("gold").alias("gold"))


@query("SELECT row_id, id, kind, md5(state) AS state, question, choices, gold, state_lang, choice_lang FROM examples")
def p01_keep(spark, d):
    return _ex(spark, d).select("row_id", "id", "kind", F.md5("state").alias("state"), "question", "choices", "gold", "state_lang", "choice_lang")


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN length(text) ELSE length(CASE WHEN position(' ' IN reverse(substr(text, 1, 300))) > 0 AND 301 - position(' ' IN reverse(substr(text, 1, 300))) > 240
    THEN substr(text, 1, (300 - position(' ' IN reverse(substr(text, 1, 300))))::BIGINT) ELSE substr(text, 1, 300) END) + 1 END AS n FROM documents WHERE text IS NOT NULL""")
def p12_cut_at_word(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.length(T.cut_at_word(F.col("text"), 300)).cast("bigint").alias("n"))


@query("SELECT doc_id, md5(CASE WHEN length(trim(text)) <= 600 THEN trim(text) ELSE substr(trim(text), 1, 600) || ' …' END) AS digest FROM documents WHERE text IS NOT NULL")
def p13_clip(spark, d):
    return _norm(spark, d, lambda c: T.clip(c, 600))


@query("SELECT DISTINCT source, trim(regexp_replace(source, '[_.-]+', ' ', 'g')) AS label FROM documents WHERE source IS NOT NULL")
def p15_pretty_label(spark, d):
    return _docs(spark, d).where("source IS NOT NULL").select("source", T.pretty_label(F.col("source")).alias("label")).distinct()


@query("SELECT row_id, md5('Premise: ' || (state ->> '$.source_text') || chr(10) || 'Hypothesis: ' || (state ->> '$.claim')) AS digest FROM examples WHERE json_valid(state) AND json_exists(state, '$.claim') AND json_exists(state, '$.source_text')")
def p16_nli_state(spark, d):
    g = lambda k: F.get_json_object("state", f"$.{k}")
    rows = _ex(spark, d).where(F.json_object_keys("state").isNotNull() & g("claim").isNotNull() & g("source_text").isNotNull())
    return rows.select("row_id", F.md5(F.format_string("Premise: %s\nHypothesis: %s", g("source_text"), g("claim"))).alias("digest"))


_FIELDS = ["text", "user", "tool_result", "output", "goal", "proposed"]


@query("SELECT row_id, md5(CASE WHEN json_valid(state) AND concat_ws(' ', " + ", ".join(f"state ->> '$.{k}'" for k in _FIELDS) + ") <> '' THEN concat_ws(' ', " + ", ".join(f"state ->> '$.{k}'" for k in _FIELDS) + ") ELSE state END) AS digest FROM examples WHERE state IS NOT NULL")
def p17_judged_text(spark, d):
    fields = F.concat_ws(" ", *[F.get_json_object("state", f"$.{k}") for k in _FIELDS])
    kept = F.when(F.json_object_keys("state").isNotNull() & (fields != ""), fields).otherwise(F.col("state"))
    return _ex(spark, d).where("state IS NOT NULL").select("row_id", F.md5(kept).alias("digest"))


@query(f"""SELECT row_id, CASE WHEN source = 'hand-written' THEN 'test' WHEN {_HEX.format("md5('s:' || source || coalesce(group_id, ''))")} / 4294967296.0 < 0.1 THEN 'test' ELSE 'train' END AS part FROM examples""")
def p32_source_split(spark, d):
    bucket = T.md5_bucket("s", F.concat("source", F.coalesce("group_id", F.lit(""))))
    return _ex(spark, d).select("row_id", F.when(F.col("source") == "hand-written", "test").when(bucket < 0.1, "test").otherwise("train").alias("part"))


@query("SELECT row_id, md5(concat_ws(chr(10), question, state)) AS digest FROM examples")
def p34_question_first(spark, d):
    return _ex(spark, d).select("row_id", F.md5(F.concat_ws("\n", "question", "state")).alias("digest"))


def _prior(spark, d):
    rows = _ex(spark, d).where("state IS NOT NULL")
    a = rows.groupBy("id").agg(F.min_by("state", "row_id").alias("before"), F.max_by("state", "row_id").alias("after"), F.count(F.lit(1)).alias("n"))
    return a.where("n > 1")


_PRIOR = "(SELECT id, arg_min(state, row_id) AS before, arg_max(state, row_id) AS after, count(*) AS n FROM examples WHERE state IS NOT NULL GROUP BY id HAVING count(*) > 1)"


@query(f"""WITH x AS (SELECT id, regexp_extract_all(before, '\\p{{Nd}}+') AS x, regexp_extract_all(after, '\\p{{Nd}}+') AS y FROM {_PRIOR})
    SELECT id, len(list_filter(x, lambda v: len(list_filter(y, lambda w: w = v)) < len(list_filter(x, lambda w: w = v)))) = 0 AND len(list_filter(y, lambda w: NOT list_contains(x, w))) = 0 AS kept FROM x""")
def p35_numbers_kept(spark, d):
    return _prior(spark, d).select("id", T.numbers_kept(F.col("before"), F.col("after")).alias("kept"))


@query(f"""SELECT id, len(list_filter(regexp_extract_all(before, 'https?://[^ \\t\\n"]+|--?[a-z][a-z-]+|/[A-Za-z0-9_./-]{{2,}}|"[^"]+"'), lambda t: NOT contains(after, t))) = 0 AS kept FROM {_PRIOR}""")
def p36_verbatim_kept(spark, d):
    return _prior(spark, d).select("id", T.verbatim_kept(F.col("before"), F.col("after")).alias("kept"))


@query("SELECT e.row_id FROM examples e JOIN (SELECT group_id FROM examples WHERE kind = 'verify' GROUP BY group_id HAVING min(gold) < max(gold)) USING (group_id) WHERE kind = 'verify'")
def p38_two_sided(spark, d):
    rows = _ex(spark, d).where("kind = 'verify'")
    sided = rows.groupBy("group_id").agg(F.min("gold").alias("a"), F.max("gold").alias("b")).where("a < b").select("group_id")
    return rows.join(sided, "group_id", "left_semi").select("row_id")


@query("""SELECT id, row_id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id, source) AS r FROM examples) WHERE r = 1""")
def w01_first_wins(spark, d):
    return S.first_wins(_ex(spark, d).select("id", "row_id", "source"), ["id"], ["row_id"])


@query(f"SELECT {_NORM_WEB.format('state')} AS key, min(gold) AS gold, min(row_id) AS row_id FROM examples WHERE state IS NOT NULL GROUP BY 1 HAVING min(gold) = max(gold)")
def w02_conflict_dedup(spark, d):
    return S.drop_conflicts(_ex(spark, d).select("state", "gold", "row_id"), T.norm_web(F.col("state")), "gold", ["row_id"])


@query("SELECT source, config, count(*) AS seen, least(count(*), 40) AS n FROM examples GROUP BY ALL")
def w03_cap(spark, d):
    rows = _ex(spark, d).select("source", "config", "row_id")
    kept = S.cap_per(rows, ["source", "config"], 40, "row_id").groupBy("source", "config").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("source", "config").agg(F.count(F.lit(1)).alias("seen")).join(kept, ["source", "config"])


@query("SELECT source, row_id, turn FROM (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY row_id) AS turn FROM examples) WHERE turn <= 60 ORDER BY turn, source LIMIT 200")
def w04_round_robin(spark, d):
    return S.round_robin(_ex(spark, d).select("source", "row_id"), "source", ["row_id"], 200, 60)


@query("SELECT row_id, list_transform(list_slice(list_reverse_sort(list_transform(probs, lambda x, i: {'p': x, 'i': -i})), 1, 3), lambda s: -s.i - 1) AS top, greatest(0, len(probs) - 3) AS more FROM examples WHERE probs IS NOT NULL")
def w08_top_options(spark, d):
    order = F.array_sort(F.transform("probs", lambda x, i: F.struct((-x).alias("p"), i.alias("i"))))
    return _ex(spark, d).where("probs IS NOT NULL").select("row_id", F.transform(F.slice(order, 1, 3), lambda s: s["i"].cast("bigint")).alias("top"), F.greatest(F.lit(0), F.size("probs") - 3).cast("bigint").alias("more"))


@query("SELECT config, row_id FROM (SELECT config, row_id, row_number() OVER (PARTITION BY config ORDER BY sha1('7:' || row_id), row_id) AS r FROM examples) WHERE r <= 40")
def w09_reservoir(spark, d):
    w = Window.partitionBy("config").orderBy(F.sha1(F.concat(F.lit("7:"), F.col("row_id").cast("string"))), "row_id")
    return _ex(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 40").select("config", "row_id")


@query("SELECT row_id FROM examples ORDER BY CASE config WHEN 'guard' THEN 0 WHEN 'triage' THEN 1 ELSE 2 END, id, row_id LIMIT 100")
def l01_config_order(spark, d):
    rank = F.when(F.col("config") == "guard", 0).when(F.col("config") == "triage", 1).otherwise(2)
    return _ex(spark, d).orderBy(rank, "id", "row_id").select("row_id").limit(100)


@query("SELECT row_id FROM examples ORDER BY sha1('seed:' || row_id), row_id LIMIT 100")
def l02_seeded_sample(spark, d):
    return _ex(spark, d).orderBy(F.sha1(F.concat(F.lit("seed:"), F.col("row_id").cast("string"))), "row_id").select("row_id").limit(100)


@query("SELECT row_id FROM examples ORDER BY sha1('case:' || coalesce(scenario, '')), scenario, row_id LIMIT 100")
def l04_whole_cases(spark, d):
    return _ex(spark, d).orderBy(F.sha1(F.concat(F.lit("case:"), F.coalesce("scenario", F.lit("")))), F.asc_nulls_last("scenario"), "row_id").select("row_id").limit(100)


@query("""SELECT id, list_transform(list_slice(list_sort(list_transform(list_filter(range(len(choices)), lambda i: i <> gold), lambda i: sha1(id || ':' || i) || '|' || i)), 1, 2), lambda s: split_part(s, '|', 2)::INT) AS distractors FROM items""")
def l06_distractors(spark, d):
    others = F.filter(F.sequence(F.lit(0), F.size("choices") - 1), lambda i: i != F.col("gold"))
    order = F.array_sort(F.transform(others, lambda i: F.struct(F.sha1(F.concat("id", F.lit(":"), i.cast("string"))).alias("h"), i.alias("i"))))
    return table(spark, d, "items").select("id", F.transform(F.slice(order, 1, 2), lambda s: s["i"]).alias("distractors"))


_SPLIT = r"CASE trim(lower(split), E' \t\n\r') WHEN 'dev' THEN 'val' WHEN 'validation' THEN 'val' ELSE trim(lower(split), E' \t\n\r') END"


def _parts(spark, d):
    rows = _ex(spark, d).withColumn("part", split_name(F.col("split"))).withColumn("g", trimmed_lower(F.col("group_id")))
    return rows.where("part = 'train'"), rows.where("part IN ('val', 'test')")


@query(f"""WITH r AS (SELECT row_id, source, {_SPLIT} AS part, CASE WHEN length({_C.format("lower(state)")}) >= 8 THEN md5({_C.format("lower(state)")}) END AS k FROM examples)
    SELECT e.row_id AS id, t.source FROM r e JOIN (SELECT k, min(source) AS source FROM r WHERE part = 'train' AND k IS NOT NULL GROUP BY k) t USING (k) WHERE part IN ('val', 'test')""")
def j06_exact_overlap(spark, d):
    train, evals = _parts(spark, d)
    return S.exact_overlap(evals, train, "state", "row_id", "source")


@query(f"""WITH r AS (SELECT row_id, kind, {_SPLIT} AS part, md5({_C.format("lower(state)")}) AS k, (list_position(probs, list_max(probs)) - 1 = gold)::INT AS hit FROM examples WHERE probs IS NOT NULL AND length({_C.format("lower(state)")}) >= 8)
    SELECT kind, count(*) AS n_clean, round(avg(hit), 6) AS clean_agreement FROM r WHERE part IN ('val', 'test') AND k NOT IN (SELECT k FROM r WHERE part = 'train') GROUP BY kind""")
def j07_clean_agreement(spark, d):
    train, evals = (x.where("probs IS NOT NULL").withColumn("k", T.overlap_key(F.col("state"))).where("k IS NOT NULL") for x in _parts(spark, d))
    clean = evals.join(train.select("k"), "k", "left_anti").withColumn("hit", (A.argmax_first(F.col("probs")) == F.col("gold")).cast("int"))
    return clean.groupBy("kind").agg(F.count(F.lit(1)).alias("n_clean"), F.round(F.avg("hit"), 6).alias("clean_agreement"))


@query(f"""WITH seg AS ({_SEG}), ev AS (SELECT DISTINCT md5('s:' || s) AS key FROM (SELECT unnest(list_append(list_transform(regexp_split_to_array(state, '[\\r\\n]+'), lambda s: {_NORM_GOLD.format("s")}), {_NORM_GOLD.format("state")})) AS s FROM items WHERE split = 'eval' AND state IS NOT NULL) WHERE length(s) >= 8
      UNION SELECT md5('p:' || substr(n, 1, 200)) FROM (SELECT {_NORM_GOLD.format("state")} AS n FROM items WHERE split = 'eval' AND state IS NOT NULL) WHERE length(n) >= 200)
    SELECT DISTINCT doc_id FROM seg JOIN ev USING (key)""")
def j08_segment_overlap(spark, d):
    held = S.segments(table(spark, d, "items").where("split = 'eval' AND state IS NOT NULL"), "id", "state").select("key").distinct()
    return S.segments(_docs(spark, d).where("text IS NOT NULL"), "doc_id", "text").join(held, "key", "left_semi").select(F.col("id").alias("doc_id")).distinct()


def _near_sql(setexpr, least):
    return f"""WITH r AS (SELECT row_id AS id, {_SPLIT} AS part, {setexpr} AS s FROM examples WHERE state IS NOT NULL AND trim(state) <> ''), f AS (SELECT * FROM r WHERE len(s) >= {least})
      SELECT a.id AS id_a, b.id AS id_b, round(len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM f a JOIN f b ON a.part IN ('val', 'test') AND b.part = 'train'
        AND len(a.s) >= 0.8 * len(b.s) AND len(b.s) >= 0.8 * len(a.s) WHERE len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.8"""


def _near(spark, d, f, least):
    train, evals = (x.where("state IS NOT NULL AND trim(state) <> ''").select("row_id", "state") for x in _parts(spark, d))
    return S.near_duplicates(evals, train, "row_id", f(F.col("state")), 0.8, least)


@query(_near_sql(f"list_distinct({_TOK.format(_NORM_AGENT.format('state'))})", 5))
def j09_near_tokens(spark, d):
    return _near(spark, d, lambda c: F.array_distinct(T.tokens(T.norm_agent(c))), 5)


@query(_near_sql("(SELECT CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE [] END FROM (SELECT " + _TOK.format(_NORM_WEB.format("state")) + " AS t))", 2))
def j10_near_shingles(spark, d):
    return _near(spark, d, lambda c: T.shingles(T.tokens(T.norm_web(c))), 2)


@query(f"""WITH r AS (SELECT row_id, {_SPLIT} AS part, {_NORM_AGENT.format("state ->> '$.proposed'")} AS t FROM examples WHERE json_valid(state) AND json_exists(state, '$.proposed')),
    f AS (SELECT *, list_distinct({_TOK.format("t")}) AS s FROM r WHERE length(t) > 10)
    SELECT e.row_id AS id_e, t.row_id AS id_t FROM f e JOIN f t ON e.part IN ('val', 'test') AND t.part = 'train' AND (e.t = t.t OR (length(e.t) > 18 AND contains(t.t, e.t))
      OR (len(e.s) >= 4 AND len(t.s) >= 4 AND len(list_intersect(e.s, t.s)) * 1.0 / (len(e.s) + len(t.s) - len(list_intersect(e.s, t.s))) >= 0.8))""")
def j11_command_overlap(spark, d):
    train, evals = (x.where(F.json_object_keys("state").isNotNull()).select("row_id", F.get_json_object("state", "$.proposed").alias("t")) for x in _parts(spark, d))
    return S.command_overlap(evals, train, "row_id", "t")


@query(f"""WITH r AS (SELECT row_id, {_SPLIT} AS part, state FROM examples WHERE state IS NOT NULL) SELECT row_id FROM r WHERE part = 'train' AND state NOT IN (SELECT state FROM r WHERE part = 'test')""")
def j12_train_not_in_test(spark, d):
    train, evals = _parts(spark, d)
    digest = F.unhex(F.sha2("state", 256)).alias("k")
    held = evals.where("part = 'test' AND state IS NOT NULL").select(digest).distinct()
    return train.where("state IS NOT NULL").select("row_id", digest).join(held, "k", "left_anti").select("row_id")


@query(f"""WITH r AS (SELECT row_id, {_SPLIT} AS part, trim(lower(group_id), E' \\t\\n\\r') AS g FROM examples) SELECT row_id FROM r WHERE part = 'train' AND g IN (SELECT g FROM r WHERE part = 'test' AND g IS NOT NULL)""")
def j13_group_leakage(spark, d):
    train, evals = _parts(spark, d)
    return train.join(evals.where("part = 'test'").select("g").distinct(), "g", "left_semi").select("row_id")


@query("SELECT a.row_id FROM (SELECT *, row_number() OVER (PARTITION BY state, question ORDER BY row_id) AS r FROM examples WHERE source = 'procedural' AND state IS NOT NULL) a WHERE r = 1 AND (state, question) NOT IN (SELECT (state, question) FROM examples WHERE source = 'paraphrase' AND state IS NOT NULL)")
def j26_exclude_pairs(spark, d):
    rows = _ex(spark, d).where("state IS NOT NULL").select("state", "question", "row_id", "source")
    own = rows.where("source = 'procedural'").groupBy("state", "question").agg(F.min("row_id").alias("row_id"))
    return own.join(rows.where("source = 'paraphrase'").select("state", "question"), ["state", "question"], "left_anti").select("row_id")


@query("SELECT source, kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM examples GROUP BY source, kind")
def a29_histogram(spark, d):
    h = _ex(spark, d).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("""WITH p AS (SELECT kind, gold, list_transform(probs, lambda x: x / list_sum(probs)) AS p FROM examples WHERE probs IS NOT NULL)
    SELECT kind, round(avg(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))), 6) AS entropy, round(avg((list_position(p, list_max(p)) - 1 = gold)::INT), 6) AS gold_top, round(avg(list_max(p)), 6) AS mean_top,
    round(avg((list_max(p) < 0.6)::INT), 6) AS ambiguous FROM p GROUP BY kind""")
def a30_label_stats(spark, d):
    rows = _ex(spark, d).where("probs IS NOT NULL").withColumn("p", A.renormalise(F.col("probs")))
    top = F.array_max("p")
    return rows.groupBy("kind").agg(
        F.round(F.avg(A.entropy(F.col("p"))), 6).alias("entropy"), F.round(F.avg((A.argmax_first(F.col("p")) == F.col("gold")).cast("int")), 6).alias("gold_top"),
        F.round(F.avg(top), 6).alias("mean_top"), F.round(F.avg((top < 0.6).cast("int")), 6).alias("ambiguous"),
    )


@query("""WITH c AS (SELECT source, n_chars, count(*) AS k FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(k) OVER (PARTITION BY source ORDER BY n_chars) AS upto, sum(k) OVER (PARTITION BY source) AS n FROM c)
    SELECT source, min(n_chars) FILTER (WHERE upto > floor(n * 0.1)) AS p10, min(n_chars) FILTER (WHERE upto > floor(n * 0.5)) AS median, min(n_chars) FILTER (WHERE upto > floor(n * 0.9)) AS p90, max(n_chars) AS longest FROM r GROUP BY source""")
def a31_percentiles(spark, d):
    """The values at 0-based places n q of the sorted list, from counts per value, so no list is collected."""
    c = _docs(spark, d).where("n_chars IS NOT NULL").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("source")
    r = c.withColumns({"upto": F.sum("k").over(w.orderBy("n_chars")), "n": F.sum("k").over(w)})
    at = lambda q, name: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("n_chars"))).alias(name)
    return r.groupBy("source").agg(at(0.1, "p10"), at(0.5, "median"), at(0.9, "p90"), F.max("n_chars").alias("longest"))


@query("""SELECT config, count(*) AS n, count(DISTINCT state) AS states, count(DISTINCT group_id) AS groups, sum(cross_lingual::INT)::BIGINT AS cross_lingual, round(avg(n_choices), 6) AS options, count(*) FILTER (WHERE probs IS NULL) AS no_probs FROM examples GROUP BY config""")
def a32_stats_block(spark, d):
    return _ex(spark, d).groupBy("config").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("state").alias("states"), F.countDistinct("group_id").alias("groups"), F.sum(F.col("cross_lingual").cast("int")).alias("cross_lingual"),
        F.round(F.avg("n_choices"), 6).alias("options"), F.count_if(F.col("probs").isNull()).alias("no_probs"),
    )


_BUCKET = "CASE WHEN n_choices <= 2 THEN '2' WHEN n_choices <= 5 THEN '3-5' WHEN n_choices <= 12 THEN '6-12' WHEN n_choices <= 50 THEN '13-50' ELSE '51+' END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM examples GROUP BY 1")
def a33_bucketed(spark, d):
    return _ex(spark, d).groupBy(F.expr(_BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT state) AS states, count(DISTINCT group_id) AS groups FROM examples")
def a34_distinct(spark, d):
    return _ex(spark, d).agg(F.countDistinct("state").alias("states"), F.countDistinct("group_id").alias("groups"))


@query("SELECT source, count(*) FILTER (WHERE kind = 'choose') AS choose, count(*) FILTER (WHERE kind = 'score') AS score, count(*) FILTER (WHERE kind = 'verify') AS verify, count(*) FILTER (WHERE kind = 'rank') AS rank FROM examples GROUP BY source")
def a35_label_pivot(spark, d):
    return _ex(spark, d).groupBy("source").pivot("kind", ["choose", "score", "verify", "rank"]).agg(F.count(F.lit(1))).na.fill(0)


@query()
def a44_sketches(spark, d):
    return _ex(spark, d).groupBy("config").agg(F.approx_count_distinct("state").alias("states"), F.percentile_approx("n_choices", [0.5, 0.9]).alias("q"))


@query("SELECT DISTINCT question, state_lang FROM examples WHERE kind = 'verify' UNION ALL SELECT DISTINCT question, lang FROM items WHERE kind = 'verify'")
def u01_union(spark, d):
    a = _ex(spark, d).where("kind = 'verify'").select("question", "state_lang").distinct()
    return a.unionByName(table(spark, d, "items").where("kind = 'verify'").select("question", F.col("lang").alias("state_lang")).distinct())


_W = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"


@query(f"""SELECT row_id, len(list_intersect({_W.format('state')}, {_W.format('question')})) AS both, len(list_distinct(list_concat({_W.format('state')}, {_W.format('question')}))) AS either FROM examples WHERE state IS NOT NULL AND question IS NOT NULL""")
def u04_token_sets(spark, d):
    a, b = (F.array_distinct(T.words(F.lower(c))) for c in ("state", "question"))
    return _ex(spark, d).where("state IS NOT NULL AND question IS NOT NULL").select("row_id", F.size(F.array_intersect(a, b)).cast("bigint").alias("both"), F.size(F.array_union(a, b)).cast("bigint").alias("either"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN state IS NULL OR trim(state) = '' THEN 'blank state' WHEN trim(question) = '' THEN 'blank question' WHEN len(list_filter(choices, lambda c: c IS NULL OR trim(c) = '')) > 0 THEN 'blank option'
    WHEN probs IS NULL THEN 'no probabilities' WHEN len(probs) <> len(choices) THEN 'lengths differ' WHEN NOT gold BETWEEN 0 AND len(choices) - 1 THEN 'gold out of range' WHEN len(list_filter(probs, lambda x: x < 0 OR x > 1)) > 0 THEN 'probability out of range'
    WHEN kind <> 'rank' AND abs(list_sum(probs) - 1) > 1e-3 THEN 'sum is not 1' WHEN kind = 'verify' AND len(choices) <> 2 THEN 'verify needs 2 options' WHEN none_idx IS NOT NULL AND NOT none_idx BETWEEN 0 AND len(choices) - 1 THEN 'none option out of range' END AS reason FROM examples) WHERE reason IS NOT NULL GROUP BY reason""")
def e22_rejects(spark, d):
    return S.validate(_ex(spark, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = Q
