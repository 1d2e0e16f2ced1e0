"""Composed builds: item sets by protocol, releases with decontamination, guard sets with quotas, training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.functions import text as T
from sievework.functions.text import split_name, trimmed_lower
from sievework.operators import batches
from sievework.operators import selection as S
from sievework.plans import datasets as D
from sievework.session import stage, table
from sievework.sources import files, protocols

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _ex(spark, d):
    return table(spark, d, "examples")


LANGS = ["ar", "de", "en", "es", "fa", "fr", "ru", "tr"]
_PART = "CASE WHEN ('0x' || substr(md5('part:' || {0}), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'calib' ELSE 'eval' END"


@query(f"""WITH p AS (SELECT row_id::VARCHAR AS id, 'choose' AS kind, 'Premise: ' || (state ->> '$.source_text') || chr(10) || 'Hypothesis: ' || (state ->> '$.claim') AS state, 3 AS n, gold % 3 AS gold FROM examples WHERE json_valid(state) AND state ->> '$.source_text' IS NOT NULL AND state ->> '$.claim' IS NOT NULL),
    l AS (SELECT doc_id::VARCHAR, 'choose', text, 8, list_position({LANGS}, lang) - 1 FROM documents WHERE lang IS NOT NULL), b AS (SELECT doc_id::VARCHAR, 'verify', text, 2, CASE WHEN source = 'agent_traces' THEN 0 ELSE 1 END FROM documents WHERE source IS NOT NULL),
    s AS (SELECT doc_id::VARCHAR, 'score', text, 3, least(2, greatest(0, floor((n_chars - 0) / 1000.0)))::INT FROM documents WHERE n_chars IS NOT NULL),
    a AS (SELECT 'pair' AS suite, * FROM p UNION ALL SELECT 'labelled', * FROM l UNION ALL SELECT 'binary', * FROM b UNION ALL SELECT 'scored', * FROM s)
    SELECT suite, id, kind, n::INT AS n_choices, gold::INT AS gold, md5(state) AS digest, {_PART.format("id")} AS split FROM a WHERE state IS NOT NULL AND trim(state) <> '' AND gold BETWEEN 0 AND n - 1""")
def e13_loaded_items(spark, d):
    """Item sets of four protocols, registered by name and loaded by pattern."""
    ex, docs = _ex(spark, d), table(spark, d, "documents")
    get = lambda k: F.get_json_object("state", f"$.{k}")
    r = files.Registry()
    r.add("pair", lambda s: protocols.pair_items(ex.where(F.json_object_keys("state").isNotNull()), F.col("row_id"), get("source_text"), get("claim"), F.col("gold") % 3, ["follows", "open", "contradicts"], "Does it follow?"))
    r.add("labelled", lambda s: protocols.labelled_items(docs, F.col("doc_id"), F.col("text"), F.col("lang"), LANGS, "Which language is it?"))
    r.add("binary", lambda s: protocols.binary_items(docs, F.col("doc_id"), F.col("text"), F.col("source") == "agent_traces", "Is it a trace?"))
    r.add("scored", lambda s: protocols.scored_items(docs, F.col("doc_id"), F.col("text"), F.col("n_chars"), ["short", "medium", "long"], 0, 3000, "How long is it?"))
    items = r.load(spark, ["pair", "labelled", "binary", "scored"])
    return items.select("suite", "id", "kind", F.size("choices").alias("n_choices"), "gold", F.md5("state").alias("digest"), "split")


_REASON = """CASE WHEN state IS NULL OR trim(state) = '' THEN 'blank state' WHEN trim(question) = '' THEN 'blank question' WHEN len(list_filter(choices, lambda c: c IS NULL OR trim(c) = '')) > 0 THEN 'blank option'
    WHEN probs IS NULL THEN 'no probabilities' WHEN len(probs) <> len(choices) THEN 'lengths differ' WHEN NOT gold BETWEEN 0 AND len(choices) - 1 THEN 'gold out of range' WHEN len(list_filter(probs, lambda x: x < 0 OR x > 1)) > 0 THEN 'probability out of range'
    WHEN kind <> 'rank' AND abs(list_sum(probs) - 1) > 1e-3 THEN 'sum is not 1' WHEN kind = 'verify' AND len(choices) <> 2 THEN 'verify needs 2 options' WHEN none_idx IS NOT NULL AND NOT none_idx BETWEEN 0 AND len(choices) - 1 THEN 'none option out of range' END"""


@query(f"""WITH v AS (SELECT * FROM (SELECT *, {D._SPLIT} AS part, row_number() OVER (PARTITION BY id ORDER BY row_id) AS r, {_REASON} AS reason FROM examples) WHERE r = 1), ok AS (SELECT * FROM v WHERE reason IS NULL),
    t AS (SELECT DISTINCT state FROM ok WHERE part = 'test'), kept AS (SELECT config, coalesce(part, 'train') AS part, state FROM ok WHERE part IS NOT DISTINCT FROM 'test' OR state NOT IN (SELECT state FROM t))
    SELECT config, part, 'kept' AS what, count(*) AS n, count(DISTINCT state) AS states FROM kept GROUP BY ALL UNION ALL SELECT config, coalesce(part, 'train'), reason, count(*), 0 FROM v WHERE reason IS NOT NULL GROUP BY ALL""")
def e15_released(spark, d):
    """A release: the first row of each id, addresses scrubbed, rows validated with the reasons of what is refused, no training
    state that is in the test split; written as a table and counted from what was written."""
    rows = S.first_wins(_ex(spark, d), ["id"], ["row_id"]).withColumn("part", F.coalesce(split_name(F.col("split")), F.lit("train")))
    good, bad = S.validate(stage(rows, "release-rows"))
    digest = F.unhex(F.sha2("state", 256))
    good = good.withColumn("k", digest).withColumn("state", T.scrub_emails(F.col("state")))
    test = good.where("part = 'test'").select("k").distinct()
    kept = good.where("part <> 'test'").join(test, "k", "left_anti").unionByName(good.where("part = 'test'"))
    out = stage(kept.select("config", "part", "id", "state", "question", "choices", "gold", "probs", "k"), "release")
    counts = out.groupBy("config", "part").agg(F.lit("kept").alias("what"), F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("states"))
    return counts.unionByName(bad.groupBy("config", "part", F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("states")))


@query(f"""WITH hit AS (SELECT DISTINCT id_t AS row_id FROM ({D.SQL["j11_command_overlap"]})), r AS (SELECT row_id, id, config, state, question, choices, {D._SPLIT} AS part FROM examples WHERE state IS NOT NULL),
    c AS (SELECT *, part = 'train' AND row_id IN (SELECT row_id FROM hit) AS copied FROM r WHERE part IN ('train', 'test')), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, part, id ORDER BY row_id) AS k FROM c WHERE NOT copied) WHERE k = 1),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, part, state, question, choices ORDER BY row_id) AS k2 FROM a) WHERE k2 = 1), t AS (SELECT DISTINCT config, state FROM b WHERE part = 'test'),
    k AS (SELECT b.*, part = 'train' AND t.state IS NOT NULL AS in_test FROM b LEFT JOIN t ON b.config = t.config AND b.state = t.state)
    SELECT k.config, k.part, count(*) FILTER (NOT in_test) AS n, count(*) FILTER (in_test) AS n_in_test, max(coalesce(x.n, 0)) AS n_copied FROM k LEFT JOIN (SELECT config, part, count(*) AS n FROM c WHERE copied GROUP BY ALL) x ON k.config = x.config AND k.part = x.part GROUP BY k.config, k.part""")
def e16_release_by_config(spark, d):
    """Per configuration: training rows that copy a held-out command stay out, each id and each record counts once, and training rows
    whose state is in the configuration's test part are dropped; what is left and why the rest went."""
    rows = _ex(spark, d).where("state IS NOT NULL").withColumn("part", split_name(F.col("split"))).where(F.col("part").isin("train", "test"))
    rows = rows.select("row_id", "id", "config", "part", F.unhex(F.sha2("state", 256)).alias("s"), F.unhex(F.sha2(F.to_json(F.struct("question", "choices")), 256)).alias("q"))
    hits = D.j11_command_overlap(spark, d).select(F.col("id_t").alias("row_id")).distinct().withColumn("copied", F.lit(True))
    marked = stage(rows.join(hits, "row_id", "left").withColumn("copied", F.coalesce("copied", F.lit(False)) & (F.col("part") == "train")), "release-marked")
    clean = S.first_wins(marked.where("not copied"), ["config", "part", "id"], ["row_id"])
    clean = S.first_wins(clean, ["config", "part", "s", "q"], ["row_id"])
    test = clean.where("part = 'test'").select("config", "s").distinct().withColumn("held", F.lit(True))
    both = clean.join(test, ["config", "s"], "left").withColumn("in_test", F.col("held").isNotNull() & (F.col("part") == "train"))
    counts = both.groupBy("config", "part").agg(F.count_if(~F.col("in_test")).alias("n"), F.count_if("in_test").alias("n_in_test"))
    gone = marked.where("copied").groupBy("config", "part").agg(F.count(F.lit(1)).alias("n_copied"))
    return counts.join(gone, ["config", "part"], "left").na.fill(0, ["n_copied"])


@query("""WITH latest AS (SELECT system_name, id, arg_max(probs, scored_at) AS probs, count(*) AS k FROM preds WHERE probs IS NOT NULL GROUP BY ALL), j AS (SELECT l.*, i.suite, len(choices) AS n FROM latest l LEFT JOIN items i USING (id))
    SELECT system_name, coalesce(suite, 'unknown') AS suite, count(*) AS n, count(*) FILTER (suite IS NOT NULL AND len(probs) = n AND list_sum(probs) > 0) AS n_valid, count(*) FILTER (k > 1) AS n_rescored, round(avg(list_max(probs) / list_sum(probs)) FILTER (suite IS NOT NULL AND len(probs) = n AND list_sum(probs) > 0), 6) AS mean_top FROM j GROUP BY ALL""")
def e17_predictions_release(spark, d):
    """The last prediction of each system and item, with the suite that owns the id; ids without an owner and vectors that do not
    fit their item are counted, not dropped silently."""
    latest = table(spark, d, "preds").where("probs IS NOT NULL").groupBy("system_name", "id").agg(F.max_by("probs", "scored_at").alias("probs"), F.count(F.lit(1)).alias("k"))
    rows = latest.join(table(spark, d, "items").select("id", "suite", F.size("choices").alias("n")), "id", "left")
    valid = F.col("suite").isNotNull() & (F.size("probs") == F.col("n")) & (A.total(F.col("probs")) > 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return rows.groupBy("system_name", F.coalesce("suite", F.lit("unknown")).alias("suite")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("k") > 1).alias("n_rescored"), F.round(F.avg(F.when(F.col("valid"), F.array_max(A.renormalise(F.col("probs"))))), 6).alias("mean_top")
    )


def _shingles_sql(text: str) -> str:
    return f"(SELECT CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE [] END FROM (SELECT {D._TOK.format(text)} AS t))"


def guard_build(rows: DataFrame, key, sets, least: int, test_quota: int, test_cap: int, train_cap: int) -> DataFrame:
    """(part, row_id). rows: (row_id, state, gold, source, group_id). Rows of one normalised text count once, none of texts whose
    labels differ; a test part is filled from the sources in turn; what resembles a test text, or shares its group, leaves
    training; each source and label then gives at most train_cap rows, the first."""
    whole = stage(S.drop_conflicts(rows, key, "gold", ["row_id", "state", "source", "group_id"]), "guard-rows")
    test = stage(S.round_robin(whole.select("source", "row_id"), "source", ["row_id"], test_quota, test_cap).select("row_id"), "guard-test")
    held = stage(whole.join(F.broadcast(test), "row_id"), "guard-held")  # test_quota rows at most
    rest = whole.join(F.broadcast(test), "row_id", "left_anti")
    near = S.near_duplicates(held.select("row_id", "state"), rest.select("row_id", "state"), "row_id", sets, 0.8, least).select(F.col("id_b").alias("row_id")).distinct()
    groups = held.where("group_id IS NOT NULL").select("group_id").distinct()
    clean = rest.join(near, "row_id", "left_anti").join(F.broadcast(groups), "group_id", "left_anti")
    train = S.first_by(clean.select("source", "gold", "row_id"), ["source", "gold"], ["row_id"], train_cap)
    return test.select(F.lit("test").alias("part"), "row_id").unionByName(train.select(F.lit("train").alias("part"), "row_id"))


def _guard_sql(where: str, key: str, sets: str, least: int, quota: int, cap: int, train_cap: int) -> str:
    return f"""WITH k AS (SELECT key, min(gold) AS gold, min(row_id) AS row_id FROM (SELECT row_id, gold, {key} AS key FROM examples WHERE {where}) GROUP BY key HAVING min(gold) IS NOT DISTINCT FROM max(gold)),
      w AS (SELECT k.key, k.gold, e.row_id, e.source, trim(lower(e.group_id), E' \\t\\n\\r') AS g, e.state FROM k JOIN examples e USING (row_id)),
      t AS (SELECT row_id FROM (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY row_id) AS turn FROM w) WHERE turn <= {cap} ORDER BY turn, source LIMIT {quota}),
      s AS (SELECT row_id, {sets} AS s FROM w), f AS (SELECT * FROM s WHERE len(s) >= {least}),
      near AS (SELECT DISTINCT b.row_id FROM f a JOIN t ON a.row_id = t.row_id JOIN f b ON b.row_id NOT IN (SELECT row_id FROM t) AND len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.8),
      c AS (SELECT * FROM w WHERE row_id NOT IN (SELECT row_id FROM t) AND row_id NOT IN (SELECT row_id FROM near) AND (g IS NULL OR g NOT IN (SELECT g FROM w JOIN t USING (row_id) WHERE g IS NOT NULL)))
      SELECT 'test' AS part, row_id FROM t UNION ALL SELECT 'train', row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY source, gold ORDER BY row_id) AS r FROM c) WHERE r <= {train_cap}"""


def _guard_rows(spark, d, where):
    return _ex(spark, d).where(where).select("row_id", "state", "gold", "source", trimmed_lower(F.col("group_id")).alias("group_id"))


_WEB = "state IS NOT NULL AND trim(state) <> '' AND config IN ('guard', 'moderation', 'triage')"


@query(_guard_sql(_WEB, D._NORM_WEB.format("state"), _shingles_sql(D._NORM_WEB.format("state")), 2, 60, 20, 15))
def e18_web_guard(spark, d):
    """A guard set of pages: texts compared by shingles of three tokens."""
    sets = T.shingles(T.tokens(T.norm_web(F.col("state"))))
    return guard_build(_guard_rows(spark, d, _WEB), T.norm_web(F.col("state")), sets, 2, 60, 20, 15)


_LLM = "state IS NOT NULL AND trim(state) <> '' AND config IN ('guard', 'agent_gate')"


@query(_guard_sql(_LLM, D._NORM_GUARD.format("state"), f"list_distinct({D._TOK.format(D._NORM_GUARD.format('state'))})", 5, 40, 15, 20))
def e19_prompt_guard(spark, d):
    """A guard set of prompts: texts compared by their tokens."""
    sets = F.array_distinct(T.tokens(T.norm_guard(F.col("state"))))
    return guard_build(_guard_rows(spark, d, _LLM), T.norm_guard(F.col("state")), sets, 5, 40, 15, 20)


@query("""WITH r AS (SELECT row_id % 6 AS d, kind, probs, CASE WHEN row_id % 6 = 5 THEN 0.1 ELSE 1 END * (probs[1] + probs[2]) AS mass FROM examples WHERE len(probs) >= 2 AND len(probs) = len(choices) AND list_max(probs) <= 1 AND list_min(probs) >= 0)
    SELECT CASE WHEN d = 1 THEN 'not JSON' WHEN d = 2 THEN 'bad pair' WHEN d = 3 THEN 'bad option' WHEN d = 4 THEN 'bad probability' WHEN kind <> 'rank' AND NOT mass BETWEEN 0.5 AND 1.02 THEN 'bad mass' ELSE 'good' END AS reason, kind, count(*) AS n FROM r GROUP BY ALL""")
def e22_replies(spark, d):
    """Replies made from the examples' two first probabilities, five of six spoilt in another way each, read and judged."""
    rows = _ex(spark, d).where((F.size("probs") >= 2) & (F.size("probs") == F.size("choices")) & (F.array_max("probs") <= 1) & (F.array_min("probs") >= 0))
    way = F.col("row_id") % 6
    p = [F.get("probs", F.lit(i)) * F.when(way == 5, 0.1).otherwise(1.0) for i in (0, 1)]
    pair = lambda i: F.array(F.lit(float(i)), p[i])
    last = F.when(way == 2, F.array(F.lit(1.0), p[1], F.lit(0.0))).when(way == 3, F.array(F.lit(99.0), p[1])).when(way == 4, F.array(F.lit(1.0), F.lit(1.7))).otherwise(pair(1))
    whole = F.to_json(F.struct(F.array(pair(0), last).alias("top")))
    reply = F.concat(F.lit("Here it is:\n"), F.when(way == 1, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole), F.lit("\nDone."))
    read = rows.select("kind", S.read_replies(reply, F.size("choices"), F.col("kind")).alias("r"))
    return read.groupBy(F.coalesce("r.reason", F.lit("good")).alias("reason"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows, sum(len(choices))::BIGINT AS n_options, true AS fits, true AS whole FROM examples WHERE state IS NOT NULL AND choices IS NOT NULL")
def e26_training_batches(spark, d):
    """Every row in one batch, no batch over its budgets of options, states and tokens; the sums over all batches are those of the table."""
    rows = _ex(spark, d).where("state IS NOT NULL AND choices IS NOT NULL").select("row_id", "state", "question", "choices")
    made = batches.training_batches(rows, "row_id", choice_budget=96, max_states=16, token_budget=2048)
    each = made.groupBy("chunk", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n_options").alias("options"), F.max("tokens").alias("longest"))
    fits = (F.col("n") == 1) | ((F.col("options") <= 96) & (F.col("n") <= 16) & (F.col("longest") * F.col("n") <= 2048))
    return each.agg(F.sum("n").alias("n_rows"), F.sum("options").alias("n_options"), F.bool_and(fits).alias("fits"), (F.countDistinct("chunk", "batch") == F.count(F.lit(1))).alias("whole"))


QUERIES = Q
