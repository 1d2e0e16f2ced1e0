"""Decision queries: bi-encoder, typed questions, routing, windows, personal data, decoding, streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.functions import decode as D
from sievework.functions import text as T
from sievework.operators import decide, metrics, spans
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


_HELD = "('0x' || substr(sha1(vec_id::VARCHAR), 1, 8))::BIGINT % 100 < 20"
_DECIDED = f"""WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE NOT ({_HELD})) GROUP BY ALL),
  o AS (SELECT label, list(x ORDER BY i) AS v FROM c GROUP BY label),
  s AS (SELECT e.vec_id, e.label AS gold, o.label AS key, list_cosine_similarity(e.embedding::DOUBLE[], o.v) / 0.05 AS z FROM embeddings e CROSS JOIN o WHERE {_HELD}),
  m AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM s), p AS (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS p, count(*) OVER (PARTITION BY vec_id) AS k FROM m),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, key) AS rn FROM p),
  d AS (SELECT vec_id, gold, key AS answer, p AS top, least(1.0, greatest(0.0, (k * p - 1) / (k - 1))) AS confidence FROM r WHERE rn = 1)
"""


def _decided(spark, d):
    e = table(spark, d, "embeddings")
    held = T.group_bucket(F.col("vec_id").cast("string")) < 20
    rows = decide.bi_encoder(e.where(held), decide.centroids(e.where(~held), "label"))
    return rows.select("vec_id", F.col("label").alias("gold"), F.get("keys", A.argmax_first(F.col("p"))).alias("answer"), F.array_max("p").alias("top"), A.confidence(F.col("p")).alias("confidence"))


@query(_DECIDED + "SELECT vec_id, gold, answer, round(top, 5) AS top, round(confidence, 5) AS confidence FROM d")
def d04_biencoder_decide(spark, d):
    return _decided(spark, d).select("vec_id", "gold", "answer", F.round("top", 5).alias("top"), F.round("confidence", 5).alias("confidence"))


@query(_DECIDED + "SELECT gold, round(sum(CASE WHEN bin >= 1 THEN abs(c - h) ELSE 0 END) / sum(n), 5) AS ece FROM (SELECT gold, ceil(round(top * 15, 9)) AS bin, count(*) AS n, sum(top) AS c, sum((answer = gold)::INT) AS h FROM d GROUP BY ALL) GROUP BY gold")
def d04_ece_by_label(spark, d):
    rows = _decided(spark, d).withColumn("correct", (F.col("answer") == F.col("gold")).cast("int"))
    return metrics.ece(rows, ["gold"]).withColumn("ece", F.round("ece", 5))


@query(_DECIDED + "SELECT vec_id, CASE WHEN confidence < 0.3 THEN 'other' ELSE answer::VARCHAR END AS branch FROM d")
def p21_route(spark, d):
    return _decided(spark, d).select("vec_id", decide.route(F.col("answer").cast("string"), F.col("confidence"), 0.3, "other").alias("branch"))


@query(_DECIDED + "SELECT vec_id, top < 0.4 AS abstain_top, confidence < 0.4 AS abstain_confidence FROM d")
def p22_abstain(spark, d):
    return _decided(spark, d).select("vec_id", (F.col("top") < 0.4).alias("abstain_top"), (F.col("confidence") < 0.4).alias("abstain_confidence"))


@query(_DECIDED + "SELECT vec_id, ['small', 'medium', 'large'][least(3, answer % 3 + 1 + CASE WHEN confidence < 0.6 THEN 1 ELSE 0 END)] AS tier FROM d")
def p23_escalate(spark, d):
    tiers = ["small", "medium", "large"]
    tier = F.get(F.array(*map(F.lit, tiers)), F.col("answer") % 3)
    return _decided(spark, d).select("vec_id", decide.escalate(tier, F.col("confidence"), tiers).alias("tier"))


SPEC = {
    "team": {"type": "choice", "instructions": "Which team is concerned?", "criteria": {"billing": "refund or invoices", "access": "password or account", "delivery": "delivery of crates", "other": None}},
    "urgent": {"type": "noul", "instructions": "Is it urgent?", "criteria": {"true": "it cannot wait"}},
    "claim": {"type": "score", "instructions": "How far is the claim supported?", "criteria": {"none": None, "partly": None, "fully": None}, "requires": ["claim"]},
}
_W = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
_SPEC_ROWS = ", ".join(
    "(" + ", ".join([f"'{q.id}'", f"'{q.kind}'", "[" + ", ".join(f"'{o}'" for o in q.options) + "]", "[" + ", ".join(f"'{k}'" for k in q.keys) + "]", f"{'true' if q.requires else 'false'}"]) + ")" for q in decide.compile_questions(SPEC)
)


@query(f"""WITH q(qid, kind, options, keys, need) AS (VALUES {_SPEC_ROWS}), s AS (SELECT row_id, {_W.format("state")} AS w, CASE WHEN json_valid(state) THEN json_type(state) = 'OBJECT' AND NOT json_exists(state, '$.claim') ELSE false END AS lacks FROM examples WHERE state IS NOT NULL AND trim(state) <> ''),
    z AS (SELECT row_id, qid, kind, keys, list_transform(options, lambda o: len(list_intersect(w, {_W.format("o")})) * 1.0 / len({_W.format("o")}) / 0.25) AS z FROM s, q WHERE NOT (need AND coalesce(lacks, false))),
    e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
    SELECT row_id AS id, qid, CASE WHEN kind = 'score' THEN round(list_sum(list_transform(p, lambda x, i: x * (i - 1))))::INT::VARCHAR ELSE keys[list_position(p, list_max(p))] END AS answer, round(list_max(p), 4) AS top FROM p""")
def d02_decide(spark, d):
    rows = table(spark, d, "examples").where("state IS NOT NULL AND trim(state) <> ''")
    return decide.decide(rows, "row_id", "state", SPEC).select("id", "qid", "answer", F.array_max("probs").alias("top"))


def _windows_sql(limit: int, overlap: int) -> str:
    """Windows of every document, by walking from one to the next: (doc_id, k, lo, hi), and tokens of each document in d."""
    last = "coalesce(list_max(list_filter(breaks, x -> x <= {0})), -1)".replace("x ->", "lambda x:")
    stop = f"CASE WHEN least({{0}} + {limit}, n) < n AND {last.format(f'least({{0}} + {limit}, n)')} > {{0}} + {limit // 2} THEN {last.format(f'least({{0}} + {limit}, n)')} ELSE least({{0}} + {limit}, n) END"
    then = f"CASE WHEN {last.format(f'b - {overlap}')} > a AND {last.format(f'b - {overlap}')} >= b - {2 * overlap} THEN {last.format(f'b - {overlap}')} ELSE greatest(b - {overlap}, a + 1) END"
    return rf"""WITH RECURSIVE piece AS (SELECT doc_id, o, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY o) AS hi, lag(t) OVER (PARTITION BY doc_id ORDER BY o) AS gap, lag(t, 2) OVER (PARTITION BY doc_id ORDER BY o) AS prev
      FROM (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS o FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+|[ \t\n\r\f]+') AS p FROM documents WHERE text IS NOT NULL))),
    tok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS i, hi - length(t) AS lo, hi, contains(gap, chr(10)) OR regexp_matches(prev, '[.!?;。！？؟]$') AS brk FROM piece WHERE NOT regexp_matches(t, '^[ \t\n\r\f]')),
    d AS (SELECT doc_id, count(*) AS n, coalesce(list(i ORDER BY i) FILTER (brk AND i > 0), []) AS breaks, list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM tok GROUP BY doc_id),
    r AS (SELECT doc_id, 0 AS k, 0::BIGINT AS a, ({stop.format("0")})::BIGINT AS b FROM d WHERE n > {limit}
      UNION ALL SELECT doc_id, k + 1, a2, ({stop.format("a2")})::BIGINT FROM (SELECT r.doc_id, k, ({then})::BIGINT AS a2, n, breaks FROM r JOIN d USING (doc_id) WHERE b < n)),
    w AS (SELECT r.doc_id, k, lo[a + 1] AS lo, hi[b] AS hi FROM r JOIN d USING (doc_id) UNION ALL SELECT doc_id, 0, 0, length(text) FROM documents LEFT JOIN d USING (doc_id) WHERE text IS NOT NULL AND coalesce(n, 0) <= {limit})
    """


@query(_windows_sql(128, 32) + 'SELECT doc_id AS id, k::INT AS "window", lo::INT AS lo, hi::INT AS hi FROM w')
def d06_windows(spark, d):
    return decide.plan_windows(table(spark, d, "documents"), "doc_id", "text", 128, 32).select("id", "window", "lo", "hi")


@query(_windows_sql(128, 32) + "SELECT doc_id, coalesce(hi[128], length(text))::INT AS hi, coalesce(n, 0) > 128 AS cut FROM documents LEFT JOIN d USING (doc_id) WHERE text IS NOT NULL")
def d08_cut(spark, d):
    """What is left of each document where a state over the limit is cut, and whether it was."""
    return decide.plan_windows(table(spark, d, "documents"), "doc_id", "text", 128, over="cut").select(F.col("id").alias("doc_id"), "hi", "cut")


@query(_windows_sql(128, 32) + "SELECT doc_id, qid, count(*) AS n_windows, CASE WHEN count(*) > 1 THEN max(hi) ELSE 0 END::INT AS upto FROM w, (VALUES ('team'), ('urgent')) q(qid) GROUP BY ALL")
def d09_window_meta(spark, d):
    """How many windows each decision over a document was put together from, and where the last one ends."""
    spec = {k: SPEC[k] for k in ("team", "urgent")}
    out = decide.decide(table(spark, d, "documents"), "doc_id", "text", spec, limit=128, overlap=32, meta=True)
    ends = F.when(F.size("windows") == F.size("window_probs"), F.array_max(F.transform("windows", lambda w: w["hi"]))).otherwise(0)
    return out.select(F.col("id").alias("doc_id"), "qid", F.when(F.col("windows").isNotNull(), F.size("windows").cast("bigint")).otherwise(F.lit(1).cast("bigint")).alias("n_windows"), ends.alias("upto"))


_PRESET = os.path.join(os.path.dirname(os.path.dirname(__file__)), "presets", "inbox.json")
_FILLED = "CASE WHEN regexp_matches(state, '^[ \\t\\n\\r]*[\\[{]') AND json_valid(state) THEN state ELSE '{\"message\":{\"body\":' || to_json(state)::VARCHAR || ',\"parts\":[' || to_json(state)::VARCHAR || ']}}' END"
_ASKED = f"""WITH q(qid, kind, options, keys, need) AS (VALUES {_SPEC_ROWS}), i AS (SELECT id, {_FILLED} AS state FROM items WHERE state IS NOT NULL),
    s AS (SELECT id, state, {_W.format("state")} AS w, len(regexp_extract_all(state, '[^ \t\n\r\f]+')) AS n, CASE WHEN json_type(state) = 'OBJECT' THEN NOT json_exists(state, '$.claim') ELSE false END AS lacks FROM i),
    z AS (SELECT id, n, qid, kind, keys, list_transform(options, lambda o: len(list_intersect(w, {_W.format("o")})) * 1.0 / len({_W.format("o")}) / 0.25) AS z FROM s, q WHERE NOT (need AND coalesce(lacks, false))),
    e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p, len(z) AS k FROM e)
"""


def _answered(spark, d, **options):
    return decide.predict_many(table(spark, d, "items"), "id", "state", _PRESET, **options)


@query(_ASKED + """SELECT id, max(keys[list_position(p, list_max(p))]) FILTER (qid = 'team') AS team, max(round(greatest(0.0, least(1.0, (k * list_max(p) - 1) / (k - 1))), 4)) FILTER (qid = 'team') AS confidence,
    max(round(p[1], 4)) FILTER (qid = 'urgent') AS urgent, max(round(p[2] + 2 * p[3], 4)) FILTER (qid = 'claim') AS claim, max(n)::INT AS input_tokens FROM p GROUP BY id""")
def d10_preset(spark, d):
    """A preset read from its file, its template filled with each state, and the answers taken from the JSON that comes out."""
    get = lambda path, kind: F.get_json_object("answers", path).cast(kind)
    return _answered(spark, d).select(
        "id", get("$.team.choice", "string").alias("team"), get("$.team.confidence", "double").alias("confidence"), get("$.urgent.noul", "double").alias("urgent"), get("$.claim.score", "double").alias("claim"), "input_tokens"
    )


@query(_ASKED + "SELECT id, count(DISTINCT qid) AS n_answers, CASE WHEN max(n) > 80 THEN 'state is ' || max(n) || ' tokens; the first 80 are read' END AS warning FROM p GROUP BY id")
def d11_predict_many(spark, d):
    out = _answered(spark, d, limit=80)
    return out.select("id", F.size(F.json_object_keys("answers")).cast("bigint").alias("n_answers"), F.get("warnings", F.lit(0)).alias("warning"))


@query(_ASKED + """SELECT id, qid, CASE kind WHEN 'verify' THEN 'noul' WHEN 'score' THEN 'score' ELSE 'choice' END AS type, CASE WHEN kind <> 'verify' THEN k ELSE 0 END AS n_probabilities, CASE WHEN kind = 'score' THEN keys[2] ELSE '' END AS level_1, CASE WHEN kind = 'choose' THEN round(p[2], 4) ELSE 0 END AS access FROM p""")
def d12_answers_json(spark, d):
    """Every answer as JSON, read back: its type, how many probabilities it lists, the legend of a score, one probability by its key."""
    q = decide.compile_questions(SPEC)
    filled = table(spark, d, "items").select("id", decide.as_state(F.col("state"), {"message": {"body": "{text}", "parts": ["{text}"]}}).alias("state"))
    out = decide.decide(filled, "id", "state", SPEC).join(F.broadcast(decide.question_table(spark, q).select("qid", "keys")), "qid")
    out = out.select("id", "qid", decide.answer_json(F.col("kind"), F.col("keys"), F.col("probs"), F.col("answer"), F.col("score"), F.col("confidence")).alias("a"))
    get = lambda path: F.get_json_object("a", path)
    n = F.size(F.json_object_keys(get("$.probabilities"))).cast("bigint")
    return out.select("id", "qid", get("$.type").alias("type"), F.when(get("$.probabilities").isNotNull(), n).otherwise(0).alias("n_probabilities"), F.coalesce(get("$.legend.1"), F.lit("")).alias("level_1"), F.coalesce(get("$.probabilities.access").cast("double"), F.lit(0.0)).alias("access"))


def _by_length():
    return lambda states, questions, kinds, options: [[-abs(len(o) - len(s)) / 50 for o in own] for s, own in zip(states, options, strict=True)]


@query(f"""WITH q(qid, kind, options, keys, need) AS (VALUES {_SPEC_ROWS}), z AS (SELECT row_id AS id, qid, q.kind, keys, list_transform(options, lambda o: -abs(length(o) - length(state)) / 50.0) AS z FROM examples, q WHERE qid = 'team' AND state IS NOT NULL),
    e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z) SELECT id, keys[list_position(e, list_max(e))] AS answer, round(list_max(e) / list_sum(e), 4) AS top FROM e""")
def d03_batch_scorer(spark, d):
    """A scorer that is a function over Arrow batches."""
    out = decide.decide(table(spark, d, "examples"), "row_id", "state", {"team": SPEC["team"]}, scorer=decide.batch_scorer(_by_length))
    return out.select("id", "answer", F.array_max("probs").alias("top"))


_T = "list_transform(range(4), lambda j: list_slice({0}, j * 16 + 1, j * 16 + 16))"


@query(f"""WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL), o AS (SELECT label, {_T.format("list(x ORDER BY i)")} AS o FROM c GROUP BY label),
    s AS (SELECT vec_id, {_T.format("embedding::DOUBLE[]")} AS s FROM embeddings),
    f AS (SELECT *, list_transform(range(1, 17), lambda i: list_sum(list_transform(s, lambda t: t[i]))) AS a, list_transform(range(1, 17), lambda i: list_sum(list_transform(o, lambda t: t[i]))) AS b FROM s, o)
    SELECT vec_id, label, round(list_avg(list_transform(o, lambda x: list_max(list_transform(s, lambda y: list_dot_product(y, x))))) + 0.5 * (list_cosine_similarity(a, b) - 0.85), 5) AS score FROM f""")
def d05_late_interaction(spark, d):
    """Each vector taken as four token vectors, against the mean vectors of the labels taken the same way."""
    e = table(spark, d, "embeddings")
    four = lambda v: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.transform(F.slice(v, j * 16 + 1, F.lit(16)), lambda x: x.cast("double")))
    options = decide.centroids(e, "label").select(F.col("key").alias("label"), four(F.col("vector")).alias("o"))  # a row a label
    rows = e.select("vec_id", four(F.col("embedding")).alias("s")).crossJoin(F.broadcast(options.limit(1000)))
    return rows.select("vec_id", "label", F.round(decide.late_interaction(F.col("s"), F.col("o"), 0.5), 5).alias("score"))


_RUNS = "SELECT system_name, id, kind, p, (row_number() OVER (PARTITION BY system_name, id ORDER BY scored_at) - 1)::INT AS w FROM (SELECT pr.*, kind, list_transform(probs, lambda x: x / list_sum(probs)) AS p FROM preds pr JOIN items USING (id) WHERE len(probs) = len(choices) AND list_sum(probs) > 0)"


@query(f"WITH r AS ({_RUNS}), x AS (SELECT system_name, id, i, avg(x) AS x FROM (SELECT system_name, id, unnest(p) AS x, unnest(range(len(p))) AS i FROM r) GROUP BY ALL) SELECT system_name, id, list(round(x, 6) ORDER BY i) AS p FROM x GROUP BY ALL")
def d07_mean(spark, d):
    return decide.aggregate_windows(_runs(spark, d), ["system_name", "id"], "mean").select("system_name", "id", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


@query(f"""WITH r AS ({_RUNS}), b AS (SELECT *, row_number() OVER (PARTITION BY system_name, id ORDER BY CASE WHEN kind = 'verify' THEN p[1] ELSE list_max(p) END DESC, w) AS k FROM r WHERE kind <> 'rank')
    SELECT system_name, id, w AS "window", list_transform(p, lambda x: round(x, 6)) AS p FROM b WHERE k = 1""")
def d07_max(spark, d):
    best = decide.aggregate_windows(_runs(spark, d), ["system_name", "id"], "max").where("kind <> 'rank'")
    return best.select("system_name", "id", "window", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


def _runs(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "preds").join(table(spark, d, "items").select("id", "kind", "choices"), "id").where(F.size("probs") == F.size("choices"))
    rows = rows.withColumn("p", A.renormalise(F.col("probs"))).where("p IS NOT NULL")
    return rows.withColumn("window", F.row_number().over(Window.partitionBy("system_name", "id").orderBy("scored_at")) - 1)


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, n, CASE WHEN n <= 60 THEN [0] ELSE list_append(range(0, n - 60, 45), n - 60) END AS starts FROM t WHERE n > 0),
    k AS (SELECT doc_id, k, s FROM (SELECT doc_id, starts, unnest(range(n)) AS k FROM s), unnest(starts) u(s) WHERE s <= k AND k < s + 60),
    b AS (SELECT doc_id, k, arg_min(s, (-least(k - s, s + 59 - k), s)) AS s FROM k GROUP BY ALL) SELECT doc_id, s::INT AS start, count(*) AS n FROM b GROUP BY ALL""")
def n06_window_merge(spark, d):
    """How many words of each document take their tag from each window."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f]+")).alias("n")).where("n > 0")
    rows = rows.withColumn("starts", spans.window_starts(F.col("n"), 60, 45))
    own = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: spans.central_window(k, F.col("starts"), 60))).alias("start"))
    return own.groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("n"))


@query()
def n01_pii_spans(spark, d):
    s = spans.pii_spans(table(spark, d, "documents"), "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", "s.*")


@query()
def n04_versions(spark, d):
    """Spans by version and label: later versions keep spelled numbers, the last adds phone numbers that only a word near them tells."""
    counts = [spans.label_counts(spans.pii_spans(table(spark, d, "documents"), "doc_id", "text", version=v), []).select(F.lit(v).alias("version"), "label", "n") for v in spans.VERSIONS]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query()
def n07_redact(spark, d):
    s = spans.pii_spans(table(spark, d, "documents"), "doc_id", "text", keep=("text",))
    return s.select(F.col("id").alias("doc_id"), spans.redact(F.col("text"), F.col("spans")).alias("text"))


_X, _S = r"[ \x{a0}()]", r"[-./]"
_DIGITS = rf"\p{{Nd}}+(?:(?:{_X}{{1,3}}|{_X}{{0,2}}{_S}|{_X}{_S}{_X}|{_S}{_X}{{1,2}})\p{{Nd}}+)*"
_RUNS_OF = f"SELECT doc_id, unnest(regexp_extract_all(text, '{_DIGITS}')) AS run FROM documents WHERE text IS NOT NULL"


@query(rf"""WITH r AS ({_RUNS_OF}), g AS (SELECT *, regexp_extract_all(run, '\p{{Nd}}+') AS p, regexp_extract_all(run, '[^\p{{Nd}}]+') AS gap FROM r)
    SELECT doc_id, kind, count(*) AS n, sum(groups)::BIGINT AS groups, sum(digits)::BIGINT AS digits FROM (SELECT doc_id, len(p) AS groups, length(array_to_string(p, '')) AS digits,
      CASE WHEN len(p) >= 4 AND len(list_filter(p, lambda x: length(x) = 4)) >= 3 THEN 'card'
      WHEN len(p) >= 3 AND regexp_matches(gap[1], '^[-./]$') AND regexp_matches(gap[2], '^[-./]$') AND ((length(p[1]) <= 2 AND length(p[2]) <= 2 AND length(p[3]) IN (2, 4)) OR (length(p[1]) = 4 AND length(p[2]) <= 2 AND length(p[3]) <= 2)) THEN 'date'
      WHEN len(list_filter(gap, lambda x: contains(x, '.'))) >= 3 THEN 'address' ELSE 'plain' END AS kind FROM g) GROUP BY ALL""")
def w11_digit_runs(spark, d):
    runs = spans.runs_of_digits(table(spark, d, "documents"), "doc_id", "text")
    return runs.groupBy(F.col("id").alias("doc_id"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("groups").alias("groups"), F.sum("digits").alias("digits"))


_PARTS = "[^ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+"


@query(rf"""WITH t AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS o FROM (SELECT doc_id, regexp_extract_all(text, '{_PARTS}') AS p FROM documents WHERE text IS NOT NULL)),
    w AS (SELECT *, CASE WHEN regexp_matches(t, '[0-9]') THEN 'CODE' WHEN regexp_matches(t, '^\p{{Lu}}') THEN 'NAME' END AS label FROM t WHERE NOT regexp_matches(t, '^[ \t\n\r\f]')),
    g AS (SELECT *, label IS NOT NULL AND label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY o) AS goes_on FROM w),
    s AS (SELECT doc_id, label, o, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY o) AS k FROM g),
    e AS (SELECT doc_id, k, label, min(o) AS a, max(o) AS b FROM s WHERE label IS NOT NULL GROUP BY ALL),
    x AS (SELECT e.doc_id, label, k, string_agg(t, '' ORDER BY o) AS body FROM e JOIN t ON e.doc_id = t.doc_id AND o BETWEEN a AND b GROUP BY ALL),
    y AS (SELECT doc_id, label, regexp_replace(regexp_replace(body, '^[«"''\x{{200e}}\x{{200f}}\x{{200c}}\s\p{{Z}}]+', ''), '[.,;:!?،؛؟»)"''۔\x{{200e}}\x{{200f}}\x{{200c}}\s\p{{Z}}]+$', '') AS body FROM x)
    SELECT doc_id, label, count(*) AS n, sum(length(body))::BIGINT AS chars FROM y WHERE body <> '' GROUP BY ALL""")
def w10_tag_segments(spark, d):
    """Words tagged by a rule, and the spans that their tags make, over whole documents."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit(_PARTS), F.lit(0)).alias("tokens"))
    tag = lambda t: F.when(t.rlike("[0-9]"), "I-CODE").when(t.rlike("^\\p{Lu}"), "I-NAME").otherwise("O")
    found = spans.tagged_segments(docs.withColumn("tags", F.transform("tokens", tag)), "doc_id", "tokens", "tags")
    return found.groupBy(F.col("id").alias("doc_id"), "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


_EMAIL = "[\\p{L}\\p{N}._%+-]+@[\\p{L}\\p{N}.-]+\\.\\p{L}{2,}"


@query(f"SELECT source, sum(len(regexp_extract_all(text, '{_EMAIL}')))::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY source HAVING n > 0")
def a40_label_counts(spark, d):
    """E-mail spans per source, counted from the recogniser's spans."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    s = spans.pii_spans(docs, "doc_id", "text", keep=("source",))
    return spans.label_counts(s, ["source"]).where("label = 'EMAIL'").select("source", "n")


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g')) AS digest FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def f40_redact(spark, d):
    """Texts with e-mail spans, these replaced."""
    s = spans.pii_spans(table(spark, d, "documents"), "doc_id", "text", keep=("text",))
    own = F.filter("spans", lambda x: x["label"] == "EMAIL")
    return s.where(F.size(own) > 0).select(F.col("id").alias("doc_id"), F.md5(spans.redact(F.col("text"), own)).alias("digest"))


@query()
def f18_decode(spark, d):
    out = table(spark, d, "documents").where("text IS NOT NULL").withColumn("d", D.decode(F.col("text")))
    return out.select("doc_id", F.md5("d.text").alias("digest"), F.size("d.kinds").alias("n"))


def _round_trip(spark, d, encoded):
    """Questions of the items, encoded and decoded again, with the kinds of what was undone."""
    out = table(spark, d, "items").select("id", D.decode(encoded(F.col("question"))).alias("d"))
    return out.select("id", F.md5("d.text").alias("digest"), F.array_join("d.kinds", " ").alias("kinds"))


def _hex(c, charset="UTF-8"):
    return F.hex(F.encode(c, charset))


@query("SELECT id, CASE WHEN n >= 3 THEN md5(question) ELSE md5(e) END AS digest, CASE WHEN n >= 3 THEN 'percent' ELSE '' END AS kinds FROM (SELECT id, question, replace(replace(url_encode(question), '~', '%7E'), '%2A', '*') AS e, len(regexp_extract_all(e, '%')) AS n FROM items)")
def f13_percent(spark, d):
    return _round_trip(spark, d, lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))


@query("SELECT id, md5(question) AS digest, 'escape' AS kinds FROM items")
def f14_escapes(spark, d):
    return _round_trip(spark, d, lambda c: F.regexp_replace(_hex(c), "(..)", r"\\x$1"))


@query("SELECT id, md5(question) AS digest, 'utf16' AS kinds FROM items")
def f15_utf16(spark, d):
    return _round_trip(spark, d, lambda c: F.rtrim(F.regexp_replace(_hex(c, "UTF-16BE"), "(....)", "0x$1, "), F.lit(", ")))


@query("SELECT id, md5(question) AS digest, 'hex' AS kinds FROM items")
def f16_bytes(spark, d):
    return _round_trip(spark, d, lambda c: F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, _hex(c)).otherwise(F.rtrim(F.regexp_replace(_hex(c), "(..)", "$1:"), F.lit(":"))))


@query("SELECT id, md5(question) AS digest, 'base64' AS kinds FROM items")
def f17_base64(spark, d):
    return _round_trip(spark, d, lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\\r\\n]", ""))


@query("SELECT row_id, (trim(lower(state ->> '$.entity_a'), '. ') = trim(lower(state ->> '$.entity_b'), '. ')) AS same FROM examples WHERE json_valid(state) AND json_exists(state, '$.entity_a') AND json_exists(state, '$.entity_b')")
def j22_record_pairs(spark, d):
    a, b = (F.trim(F.lower(F.get_json_object("state", f"$.{k}")), F.lit(". ")) for k in ("entity_a", "entity_b"))
    rows = table(spark, d, "examples").where(F.json_object_keys("state").isNotNull())
    return rows.withColumn("same", a == b).where("same IS NOT NULL").select("row_id", "same")


@query("""SELECT row_id, md5(CASE WHEN regexp_matches(state, '^[ \t\n\r]*[\\[{]') AND json_valid(state) THEN state ELSE '{"case":{"note":' || to_json(state)::VARCHAR || '}}' END) AS digest FROM examples WHERE state IS NOT NULL""")
def p06_text_or_state(spark, d):
    """JSON stays, other text is put into a nested template."""
    made = decide.as_state(F.col("state"), {"case": {"note": "{text}"}})
    return table(spark, d, "examples").where("state IS NOT NULL").select("row_id", F.md5(made).alias("digest"))


_PIECE = D.PIECE.replace("'", "''")


@query(rf"""SELECT row_id, list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all(state ->> '$.proposed', '{_PIECE}'), lambda p: CASE WHEN p IN ('&&', '||', ';', '|', chr(10)) THEN chr(1) ELSE p END), ''), chr(1)),
    lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS parts FROM examples WHERE json_valid(state) AND json_exists(state, '$.proposed') AND state ->> '$.proposed' IS NOT NULL""")
def p25_chain_parts(spark, d):
    rows = table(spark, d, "examples").where(F.json_object_keys("state").isNotNull())
    proposed = F.get_json_object("state", "$.proposed")
    return rows.where(proposed.isNotNull()).select("row_id", D.chain_parts(proposed).alias("parts"))


@query("SELECT DISTINCT id, system_name FROM preds")
def t01_idempotent_append(spark, d):
    return logs.append_once(spark, f"{d}/preds.parquet", table(spark, d, "preds").schema, ["id", "system_name"]).select("id", "system_name")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def t02_stream_counts(spark, d):
    return logs.windowed_counts(spark, f"{d}/events.parquet", table(spark, d, "events").schema, "ts", "event_type")


QUERIES = Q
