"""Assembling, comparing and presenting: joins between runs, orders and samples, merges, option texts, report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.functions import text as T
from sievework.operators import metrics, spans
from sievework.operators import selection as S
from sievework.plans.decisions import _EMAIL as EMAIL
from sievework.plans.evaluation import _BASE, _boot_sql, _ev
from sievework.session import table
from sievework.streaming import logs

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_ANSWERS = "SELECT id AS case_id, q_index, coalesce(split_part(state_lang, '-', 1), '') AS lang, min_by(gold = list_position(probs, list_max(probs)) - 1, row_id) AS hit FROM examples WHERE probs IS NOT NULL AND q_index IS NOT NULL AND scenario IS NOT NULL GROUP BY ALL"


@query(_ANSWERS.replace("id AS case_id", "scenario AS case_id").join(["WITH x AS (", ") SELECT a.case_id, a.q_index, a.lang AS lang_a, b.lang AS lang_b FROM x a JOIN x b ON a.case_id = b.case_id AND a.q_index = b.q_index AND a.lang <> b.lang WHERE a.hit AND NOT b.hit"]))
def j15_answer_flip(spark, d):
    """Questions of a case that are answered right in one language and wrong in another: a self-join on case and question."""
    rows = table(spark, d, "examples").where("probs IS NOT NULL AND q_index IS NOT NULL AND scenario IS NOT NULL")
    hit = F.col("gold") == A.argmax_first(F.col("probs"))
    lang = F.coalesce(F.split_part("state_lang", F.lit("-"), F.lit(1)), F.lit(""))
    x = rows.groupBy(F.col("scenario").alias("case_id"), "q_index", lang.alias("lang")).agg(F.min_by(hit, "row_id").alias("hit"))
    right = x.where("hit").select("case_id", "q_index", F.col("lang").alias("lang_a"))
    wrong = x.where("not hit").select("case_id", "q_index", F.col("lang").alias("lang_b"))
    return right.join(wrong, ["case_id", "q_index"]).where("lang_a <> lang_b")


@query("""WITH o AS (SELECT id, 'scored' AS owner, 1 AS rank FROM items WHERE split = 'eval' UNION ALL SELECT id, 'listed', 2 FROM manifest UNION ALL SELECT group_id, 'copied', 3 FROM items WHERE group_id IS NOT NULL),
    one AS (SELECT id, arg_min(owner, rank) AS owner, count(DISTINCT owner) AS n_sets FROM o GROUP BY id) SELECT system_name, coalesce(owner, 'unknown') AS owner, count(*) AS n, count(*) FILTER (WHERE n_sets > 1) AS contested FROM preds LEFT JOIN one USING (id) GROUP BY ALL""")
def j18_owner_of_id(spark, d):
    """The set that owns each prediction's id: an id in several sets belongs to the first of them and counts as contested."""
    items = table(spark, d, "items")
    sets = [items.where("split = 'eval'").select("id"), table(spark, d, "manifest").select("id"), items.where("group_id IS NOT NULL").select(F.col("group_id").alias("id"))]
    own = S.owners([(name, s) for name, s in zip(("scored", "listed", "copied"), sets, strict=True)], "id")
    rows = table(spark, d, "preds").select("system_name", "id").join(own, "id", "left")
    return rows.groupBy("system_name", F.coalesce("owner", F.lit("unknown")).alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_sets") > 1).alias("contested"))


_TWO = "SELECT id, arg_min(config, row_id) AS config, arg_min(probs, row_id) AS a, arg_max(probs, row_id) AS b, count(*) AS k FROM examples WHERE probs IS NOT NULL GROUP BY id"


@query(f"SELECT config, count(*) AS n, round(avg((x > 0.5)::INT = (y > 0.5)::INT), 6) AS agreement, round(avg(abs(x - y)), 6) AS mean_gap FROM (SELECT config, unnest(a) AS x, unnest(b) AS y FROM ({_TWO}) WHERE k > 1 AND len(a) = len(b)) GROUP BY config".replace("avg((x > 0.5)::INT = (y > 0.5)::INT)", "avg(((x > 0.5) = (y > 0.5))::INT)"))
def j19_relabel_agreement(spark, d):
    """The first and the last labels of an id, joined by position."""
    rows = table(spark, d, "examples").where("probs IS NOT NULL")
    two = rows.groupBy("id").agg(F.min_by("config", "row_id").alias("config"), F.min_by("probs", "row_id").alias("a"), F.max_by("probs", "row_id").alias("b"), F.count(F.lit(1)).alias("k"))
    each = two.where((F.col("k") > 1) & (F.size("a") == F.size("b"))).select("config", F.explode(F.arrays_zip("a", "b")).alias("z"))
    same = ((F.col("z.a") > 0.5) == (F.col("z.b") > 0.5)).cast("int")
    return each.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("agreement"), F.round(F.avg(F.abs(F.col("z.a") - F.col("z.b"))), 6).alias("mean_gap"))


@query("SELECT suite, id FROM (SELECT suite, id, row_number() OVER (PARTITION BY suite ORDER BY id) AS r FROM items WHERE group_id IS NULL) WHERE r <= 5")
def l05_first_n(spark, d):
    w = Window.partitionBy("suite").orderBy("id")
    return table(spark, d, "items").where("group_id IS NULL").withColumn("r", F.row_number().over(w)).where("r <= 5").select("suite", "id")


@query("SELECT i.id, coalesce(m.lang, i.lang) AS lang, coalesce(m.kind, i.kind) AS kind FROM items i LEFT JOIN manifest m USING (id)")
def u05_merge_right_wins(spark, d):
    right = table(spark, d, "manifest").select("id", F.col("lang").alias("l"), F.col("kind").alias("k"))
    return table(spark, d, "items").join(right, "id", "left").select("id", F.coalesce("l", "lang").alias("lang"), F.coalesce("k", "kind").alias("kind"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def u06_distinct_texts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.unhex(F.md5("text")).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))::BIGINT AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT n, count(*) AS k, coalesce(sum(n * count(*)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t GROUP BY n),
    r AS (SELECT t.n, before + t.n * row_number() OVER (PARTITION BY t.n ORDER BY doc_id) AS upto FROM t JOIN c USING (n)) SELECT (greatest(0, upto - 1) // 4096)::BIGINT AS batch, count(*) AS docs, max(n) AS longest, sum(n)::BIGINT AS words FROM r GROUP BY batch""")
def w14_length_batches(spark, d):
    """Batches of documents of like length under a budget of words. Counts by length give the words before each length; within
    a length all sizes are equal, so a rank gives a document's place: the same batches however the table is partitioned."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f]+")).cast("bigint").alias("n"))
    placed = S.sized_places(docs, "n", "doc_id")
    return placed.groupBy(F.floor(F.greatest(F.lit(0), F.col("upto") - 1) / 4096).alias("batch")).agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("longest"), F.sum("n").alias("words"))


_TOKENS = "[\\p{L}\\p{N}]{1,6}|[^\\p{L}\\p{N}\\s]"


@query(f"""WITH t AS (SELECT row_id, question, choices, len(regexp_extract_all(question, '{_TOKENS}')) AS q, list_transform(choices, lambda c: len(regexp_extract_all(c, '{_TOKENS}'))) AS n, regexp_extract_all(question, '[^ \\t\\n\\r\\f]+') AS w FROM examples WHERE question IS NOT NULL AND choices IS NOT NULL),
    h AS (SELECT *, list_transform(range(len(w) + 1), lambda k: len(regexp_extract_all(array_to_string(list_slice(w, 1, k), ' '), '{_TOKENS}'))) AS heads FROM t)
    SELECT row_id, list_transform(n, lambda x: CASE WHEN q + x + 1 <= 24 THEN len(w) ELSE greatest(0, len(list_filter(heads, lambda h: h + x + 1 <= 24)) - 1) END) AS kept FROM h""")
def p11_fit_options(spark, d):
    """How many words of the question stand before each option so that both fit a window of 24 tokens: the longest head, found among
    the sizes of all heads."""
    rows = table(spark, d, "examples").where("question IS NOT NULL AND choices IS NOT NULL")
    w = F.regexp_extract_all("question", F.lit("[^ \\t\\n\\r\\f]+"), F.lit(0))
    return rows.select("row_id", T.fitting_heads(w, F.col("question"), F.col("choices"), 24).alias("kept"))


_LINE = "k || ': ' || CASE json_type(v) WHEN 'ARRAY' THEN chr(10) || array_to_string(list_transform(json_extract_string(v, '$[*]'), lambda x: '  - ' || replace(x, chr(10), chr(10) || '    ')), chr(10)) ELSE replace(v ->> '$', chr(10), chr(10) || '  ') END"


@query(f"""WITH j AS (SELECT row_id, unnest(json_keys(state)) AS k, generate_subscripts(json_keys(state), 1) AS o, json_extract(state, '$."' || unnest(json_keys(state)) || '"') AS v FROM examples WHERE json_valid(state) AND json_type(state) = 'OBJECT'),
    t AS (SELECT row_id, string_agg({_LINE}, chr(10) ORDER BY o) AS t FROM j GROUP BY row_id) SELECT row_id, md5(coalesce(t, state)) AS digest FROM examples LEFT JOIN t USING (row_id) WHERE state IS NOT NULL""")
def p14_render_state(spark, d):
    """JSON states as indented lines: `key: value`, objects and lists of any depth below their key, two blanks deeper; other texts
    as they are."""
    return table(spark, d, "examples").where("state IS NOT NULL").select("row_id", F.md5(T.render_state(F.col("state"))).alias("digest"))


@query(f"SELECT doc_id, 'EMAIL_ADDRESS' AS entity, len(regexp_extract_all(text, '{EMAIL}'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def p28_label_map(spark, d):
    """Spans under the entity names of another scheme, those that are wanted only."""
    s = spans.pii_spans(table(spark, d, "documents"), "doc_id", "text")
    named = spans.renamed(F.col("spans"), {"EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "CARD": "CREDIT_CARD", "IBAN": "IBAN_CODE", "PERSON_NAME": "PERSON"}, ["EMAIL_ADDRESS"])
    return s.select(F.col("id").alias("doc_id"), F.explode(named).alias("s")).groupBy("doc_id", F.col("s.label").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query()
def p27_mask_or_block(spark, d):
    s = spans.pii_spans(table(spark, d, "documents"), "doc_id", "text", keep=("text",))
    return s.select(F.col("id").alias("doc_id"), spans.mask_or_block(F.col("text"), F.col("spans"), labels=["EMAIL", "CARD", "IBAN"]).alias("r")).select("doc_id", "r.*")


@query("SELECT DISTINCT question, array_to_string(list_transform(regexp_extract_all(question, '[\\p{L}]+'), lambda w: upper(substr(w, 1, 1))), '') AS acronym FROM items")
def f43_acronym(spark, d):
    letters = F.transform(F.regexp_extract_all("question", F.lit("[\\p{L}]+"), F.lit(0)), lambda w: F.upper(F.substring(w, 1, 1)))
    return table(spark, d, "items").select("question", F.array_join(letters, "").alias("acronym")).distinct()


@query("SELECT row_id, repeat('█', floor(list_max(probs) * 10)::INT) AS bar FROM examples WHERE probs IS NOT NULL")
def f41_bar(spark, d):
    return table(spark, d, "examples").where("probs IS NOT NULL").select("row_id", F.repeat(F.lit("█"), F.floor(F.array_max("probs") * 10).cast("int")).alias("bar"))


@query(_BASE + "SELECT suite, round(avg(correct) FILTER (WHERE system_name = 'base-a'), 6) AS a, round(avg(correct) FILTER (WHERE system_name = 'base-b'), 6) AS b, round(avg(correct) FILTER (WHERE system_name = 'rules'), 6) AS r FROM ev GROUP BY suite")
def e04_side_by_side(spark, d):
    p = _ev(spark, d).groupBy("suite").pivot("system_name", ["base-a", "base-b", "rules"]).agg(F.round(F.avg("correct"), 6))
    return p.withColumnsRenamed({"base-a": "a", "base-b": "b", "rules": "r"})


@query(f"SELECT suite, count(*) AS n, sum((len(regexp_extract_all(state, '{_TOKENS}')) > 120)::INT)::BIGINT AS long_states, sum((list_max(list_transform(choices, lambda c: len(regexp_extract_all(c, '{_TOKENS}')))) > 8)::INT)::BIGINT AS long_options FROM items GROUP BY suite")
def e06_budget_flags(spark, d):
    """Items whose state or longest option is over its budget of tokens."""
    n = lambda c: F.regexp_count(c, F.lit(_TOKENS))
    return table(spark, d, "items").groupBy("suite").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(n("state") > 120).alias("long_states"), F.count_if(F.array_max(F.transform("choices", n)) > 8).alias("long_options")
    )


@query("""SELECT question, list(row_id ORDER BY row_id) AS ids, list(length(state) ORDER BY row_id) AS sizes, list((gold = 0)::INT ORDER BY row_id) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY row_id) AS k FROM examples WHERE kind = 'verify' AND state IS NOT NULL AND gold IS NOT NULL) WHERE k <= 50 GROUP BY question HAVING count(*) > 1""")
def e14_batched_items(spark, d):
    """The chunks of one query as the options of one rank item, each with its relevance; an item holds at most 50 chunks, as an
    item's options are bounded."""
    rows = table(spark, d, "examples").where("kind = 'verify' AND state IS NOT NULL AND gold IS NOT NULL")
    few = S.first_by(rows, ["question"], ["row_id"], 50)
    item = few.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("row_id", F.length("state").cast("bigint").alias("size"), (F.col("gold") == 0).cast("int").alias("hit")))).alias("c")).where(F.size("c") > 1)
    return item.select("question", F.col("c.row_id").alias("ids"), F.col("c.size").alias("sizes"), F.col("c.hit").alias("relevant"))


@query("""SELECT row_id, CASE WHEN ('0x' || substr(sha1(id), 1, 8))::BIGINT % 10000 / 10000.0 < 0.1 THEN 'dev' ELSE 'train' END AS part, md5(question || chr(10) || array_to_string(choices, ' | ')) AS prompt FROM examples WHERE state IS NOT NULL""")
def e21_render_rows(spark, d):
    part = F.when(T.group_bucket(F.col("id"), 10_000) / 10_000 < 0.1, "dev").otherwise("train")
    return table(spark, d, "examples").where("state IS NOT NULL").select("row_id", part.alias("part"), F.md5(F.concat("question", F.lit("\n"), F.array_join("choices", " | "))).alias("prompt"))


_SLOT = "('0x' || substr(md5(row_id || ':' || k), 1, 8))::BIGINT % n"


@query(f"""WITH f AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS slot FROM documents WHERE length(text) BETWEEN 80 AND 400), c AS (SELECT count(*) AS n FROM f),
    e AS (SELECT row_id, state, k, ('0x' || substr(md5(row_id || ':at'), 1, 8))::BIGINT % 5 AS place, ({_SLOT}) AS slot FROM examples, c, range(4) r(k) WHERE state IS NOT NULL),
    p AS (SELECT row_id, k AS o, text FROM e JOIN f USING (slot) UNION ALL SELECT row_id, place - 0.5, state FROM e WHERE k = 0) SELECT row_id, md5(string_agg(text, chr(10) ORDER BY o)) AS digest FROM p GROUP BY row_id""")
def e23_burial(spark, d):
    """Each state among four filler texts, at a place drawn by hash; fillers are drawn by hash from the documents of 80 to 400
    characters, numbered without a window over all of them."""
    short = table(spark, d, "documents").where(F.length("text").between(80, 400)).select("doc_id", "text")
    fill = S.numbered(short, "doc_id").select(F.col("number").alias("slot"), "text")
    n = fill.agg(F.count(F.lit(1)).alias("n"))  # one row
    hashed = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
    key = F.col("row_id").cast("string")
    rows = table(spark, d, "examples").where("state IS NOT NULL").select("row_id", "state", (hashed(F.concat(key, F.lit(":at"))) % 5).alias("at"))
    asked = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).crossJoin(n)
    asked = asked.select("row_id", "k", (hashed(F.concat(key, F.lit(":"), F.col("k").cast("string"))) % F.col("n")).alias("slot"))
    pieces = asked.join(fill, "slot").select("row_id", F.col("k").cast("double").alias("o"), "text").unionByName(rows.select("row_id", (F.col("at") - 0.5).alias("o"), F.col("state").alias("text")))
    return pieces.groupBy("row_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda s: s["text"]), "\n")).alias("digest"))


@query("""SELECT kind, round(avg(-list_sum(list_transform(q, lambda x, i: x * ln(greatest(p[i], 1e-12))))), 6) AS soft_ce, round(avg(-ln(greatest(p[gold + 1], 1e-12))), 6) AS nll FROM (SELECT kind, gold, list_transform(probs, lambda x: x / list_sum(probs)) AS p,
    list_transform(range(n_choices), lambda i: CASE WHEN n_choices = 1 THEN 1.0 WHEN i = gold THEN 0.92 ELSE 0.08 / (n_choices - 1) END) AS q FROM examples WHERE probs IS NOT NULL AND kind <> 'rank') GROUP BY kind""")
def e27_losses(spark, d):
    rows = table(spark, d, "examples").where("probs IS NOT NULL AND kind <> 'rank'").withColumn("p", A.renormalise(F.col("probs"))).withColumn("q", A.smooth_labels(F.col("n_choices"), F.col("gold")))
    ce = -A.total(F.zip_with("q", "p", lambda q, p: q * F.ln(F.greatest(p, F.lit(A.EPS)))))
    return rows.groupBy("kind").agg(F.round(F.avg(ce), 6).alias("soft_ce"), F.round(F.avg(A.nll(F.col("p"), F.col("gold"))), 6).alias("nll"))


@query(_BASE + "SELECT a.id, a.pred AS rule, b.pred AS model FROM ev a JOIN ev b USING (id) WHERE a.system_name = 'rules' AND b.system_name = 'base-a' AND a.pred <> b.pred AND b.top >= 0.5")
def t03_disagreements(spark, d):
    """A log of what a rule and a model said, and its rows in which they differ and the model is sure."""
    ev = _ev(spark, d)
    rule = ev.where("system_name = 'rules'").select("id", F.col("pred").alias("rule"))
    log = rule.join(ev.where("system_name = 'base-a'").select("id", F.col("pred").alias("model"), F.col("top").alias("confidence")), "id")
    return logs.disagreements(log, "rule", "model", "confidence", 0.5).select("id", "rule", "model")


@query("SELECT split_part(source, '_', 1) AS prefix, count(*) AS n, sum(coalesce(n_chars, 0))::BIGINT AS total, count(*) FILTER (WHERE n_chars IS NULL) AS missing FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def a46_prefix_sums(spark, d):
    """Sums by the first part of a name, as parameters are counted by a tensor's."""
    rows = table(spark, d, "documents").where("source IS NOT NULL")
    return rows.groupBy(F.split_part("source", F.lit("_"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("total"), F.count_if(F.col("n_chars").isNull()).alias("missing"))


@query(_BASE + "SELECT system_name, lang, round(avg(correct), 6) AS accuracy, round(avg(top), 6) AS mean_top, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) >= 5")
def a15_by_language(spark, d):
    return _ev(spark, d).groupBy("system_name", "lang").agg(F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("top"), 6).alias("mean_top"), F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(_BASE + _boot_sql("ev", "system_name, suite"))
def e10_bootstrap_by_suite(spark, d):
    return metrics.bootstrap_ci(_ev(spark, d), ["system_name", "suite"], F.md5("state"))


_NUMBERS = ", ".join(f"'{w}'" for w in sorted(spans._number_words()))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '\\p{{Nd}}')) + 2 * len(list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: w IN ({_NUMBERS}))) AS n FROM documents WHERE text IS NOT NULL")
def f36_digit_count(spark, d):
    """Digits of any script, and two for each number word of eight languages."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", spans.digits_in(F.col("text")).cast("bigint").alias("n"))


QUERIES = Q
