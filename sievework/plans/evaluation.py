"""Evaluation queries over items, preds, manifest and examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.operators import metrics as M
from sievework.session import table

KEYS = ["system_name", "suite"]


def _ev(spark, d):
    return M.evaluated(table(spark, d, "items"), table(spark, d, "preds"))


def _all(spark, d):
    return M.scored(table(spark, d, "items"), table(spark, d, "preds"))


def _r(c, name):
    return F.round(c, 6).alias(name)


def a01_accuracy(spark, d):
    return _ev(spark, d).groupBy(*KEYS).agg(_r(F.avg("correct"), "accuracy"), F.count(F.lit(1)).alias("n"))


def a02_brier(spark, d):
    return _ev(spark, d).groupBy(*KEYS).agg(_r(F.avg("brier"), "brier"))


def a03_nll(spark, d):
    rows = _ev(spark, d)
    return rows.groupBy(*KEYS).agg(_r(F.avg(A.nll(F.col("p"), F.col("gold"), added=True)), "nll_added"), _r(F.avg("nll"), "nll_clipped"))


def a04_ece15(spark, d):
    return M.ece(_ev(spark, d), KEYS, 15)


def a05_ece10(spark, d):
    return M.ece(_ev(spark, d), KEYS, 10)


def a06_ece10_zero(spark, d):
    return M.ece(_ev(spark, d), KEYS, 10, "confidence", zero_in_first=True)


def _texts(rows):
    return rows.withColumns({"gold_text": A.at(F.col("choices"), F.col("gold")), "pred_text": A.at(F.col("choices"), F.col("pred"))})


def a07_macro_f1(spark, d):
    return M.macro_f1(_texts(_ev(spark, d)), KEYS, F.col("gold_text"), F.col("pred_text"))


def a08_macro_f1_union(spark, d):
    return M.macro_f1(_texts(_ev(spark, d)), KEYS, F.col("gold_text"), F.col("pred_text"), union=True)


def _grid(spark, d, items):
    """Every system by every suite with the suite's number of items: two short lists, whatever the number of items."""
    suites = items.groupBy("suite").agg(F.count(F.lit(1)).alias("n_items"))
    return table(spark, d, "preds").select("system_name").distinct().crossJoin(suites)


def a09_conservative_f1(spark, d):
    """Unanswered items count in the denominator of their gold label; a label without any answer has F1 0."""
    items = table(spark, d, "items").where("split = 'eval' AND group_id IS NULL")
    goals = items.select("suite", A.at(F.col("choices"), F.col("gold")).alias("label")).groupBy("suite", "label").agg(F.count(F.lit(1)).alias("n_items"))
    counts = M.label_counts(_texts(_ev(spark, d)), KEYS, F.col("gold_text"), F.col("pred_text")).join(goals, ["suite", "label"])
    sums = counts.groupBy(*KEYS).agg(F.sum(2 * F.col("tp") / (F.col("n_pred") + F.col("n_items"))).alias("f1"))
    labels = goals.groupBy("suite").agg(F.count(F.lit(1)).alias("n"))
    return _grid(spark, d, items).join(labels, "suite").join(sums, KEYS, "left").select(*KEYS, _r(F.coalesce("f1", F.lit(0.0)) / F.col("n"), "f1"))


def _ndcg(spark, d):
    rows = _ev(spark, d).where("kind = 'rank'")
    options = rows.select(*KEYS, "id", "gold", F.posexplode("p").alias("i", "x"))
    rank = options.groupBy(*KEYS, "id", "gold").agg(F.array_sort(F.collect_list(F.struct((-F.col("x")).alias("minus"), "i"))).alias("order"))
    place = F.array_position(F.transform("order", lambda o: o["i"]), F.col("gold"))
    gain = F.when((place >= 1) & (place <= 10), 1 / F.log2(place + 1)).otherwise(0.0)
    n = F.least(F.size("order"), F.lit(10))
    base = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1)) / F.size("order")
    return rank.select(*KEYS, "id", gain.alias("ndcg"), base.alias("random"))


def a10_ndcg10(spark, d):
    return _ndcg(spark, d).groupBy(*KEYS).agg(_r(F.avg("ndcg"), "ndcg"))


def a11_random_ndcg(spark, d):
    return _ndcg(spark, d).groupBy(*KEYS).agg(_r(F.avg("random"), "random_ndcg"))


def a12_skill(spark, d):
    x = _ndcg(spark, d).groupBy(*KEYS).agg(F.avg("ndcg").alias("x"), F.avg("random").alias("b"))
    return x.select(*KEYS, _r(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("x") - F.col("b"), 1 - F.col("b")))), "skill"))


def a13_case_exact(spark, d):
    cases = _ev(spark, d).groupBy(*KEYS, F.md5("state").alias("case")).agg(F.bool_and(F.col("correct") == 1).alias("ok"))
    return cases.groupBy(*KEYS).agg(_r(F.avg(F.col("ok").cast("int")), "case_exact"), F.count(F.lit(1)).alias("n_cases"))


def a14_valid_groups(spark, d):
    """A case counts only if every item of it was answered."""
    items = table(spark, d, "items").where("split = 'eval' AND group_id IS NULL")
    cases = items.groupBy("suite", F.md5("state").alias("case")).agg(F.count(F.lit(1)).alias("n"))
    got = _ev(spark, d).groupBy(*KEYS, F.md5("state").alias("case")).agg(F.count(F.lit(1)).alias("answered"), F.sum("correct").alias("right"))
    good = got.join(cases, (got["suite"] == cases["suite"]) & got["case"].eqNullSafe(cases["case"]) & (got["answered"] == cases["n"])).select("system_name", got["suite"], "right")
    sums = good.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_good"), F.sum("right").alias("right"))
    full = _grid(spark, d, items).join(sums, KEYS, "left").na.fill(0, ["n_good", "right"])
    return full.select(*KEYS, "n_good", _r(F.col("right") / F.col("n_items"), "score"))


def a15_macro_by_lang(spark, d):
    return _ev(spark, d).groupBy(*KEYS, "lang").agg(F.avg("correct").alias("a")).groupBy(*KEYS).agg(_r(F.avg("a"), "macro_accuracy"))


def a16_realised_quality(spark, d):
    rows = _ev(spark, d).where("kind = 'score'")
    quality = 1 - F.abs(F.col("pred") - F.col("gold")) / (F.size("p") - 1)
    return rows.groupBy(*KEYS).agg(_r(F.avg(quality), "quality"))


def _families(spark, d):
    s = _ev(spark, d).groupBy(*KEYS).agg(F.avg("correct").alias("x"), F.avg(1 / F.size("p")).alias("b"))
    return s.withColumn("family", F.substring_index("suite", "/", 1))


def a17_index(spark, d):
    skill = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x") - F.col("b")) / (1 - F.col("b"))))
    f = _families(spark, d).groupBy("system_name", "family").agg(F.avg("x").alias("x"), F.avg("b").alias("b"), F.avg(skill).alias("s"))
    return f.groupBy("system_name").agg(_r(100 * F.avg("x"), "index"), _r(100 * F.avg("b"), "chance_index"), _r(100 * F.avg("s"), "balanced_skill"))


def a18_family_mean(spark, d):
    """Null unless every suite of the family was scored."""
    items = table(spark, d, "items").where("split = 'eval' AND group_id IS NULL")
    want = items.select(F.substring_index("suite", "/", 1).alias("family"), "suite").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("want"))
    got = _families(spark, d).groupBy("system_name", "family").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("got"))
    return got.join(want, "family").select("system_name", "family", F.when(F.col("got") == F.col("want"), F.round("x", 6)).alias("mean"))


def a19_flip_rate(spark, d):
    rows = _all(spark, d).where("split = 'eval'")
    flip = rows.where("group_id IS NOT NULL").select("system_name", "suite", F.col("group_id").alias("id"), A.at(F.col("perm"), F.col("pred")).alias("back"))
    orig = rows.where("group_id IS NULL").select("system_name", "id", "pred")
    return flip.join(orig, ["system_name", "id"]).groupBy(*KEYS).agg(_r(F.avg((F.col("back") != F.col("pred")).cast("int")), "flip_rate"), F.count(F.lit(1)).alias("n"))


def a20_coverage(spark, d):
    items = table(spark, d, "items").where("split = 'eval' AND group_id IS NULL").groupBy("suite").agg(F.count(F.lit(1)).alias("n_items"))
    got = _ev(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.median(F.size("p")).alias("median_options"))
    return got.join(items, "suite").select(*KEYS, "n", "n_items", _r(F.col("n") / F.col("n_items"), "coverage"), "median_options")


def a21_temperature(spark, d):
    return M.temperature_fit(_all(spark, d).where("split = 'calib' AND group_id IS NULL AND kind <> 'rank'"), ["system_name"])


def a22_tempered_ece(spark, d):
    fit = a21_temperature(spark, d).select("system_name", "temperature")
    rows = _ev(spark, d).where("kind <> 'rank'").join(fit, "system_name")
    rows = rows.withColumn("top", F.array_max(A.temper(F.col("p"), F.col("temperature"))))
    return M.ece(rows, ["system_name"], 15)


def a23_bootstrap_ci(spark, d):
    return M.bootstrap_ci(_ev(spark, d), ["system_name"], F.md5("state"))


def a24_paired_difference(spark, d):
    rows = _ev(spark, d)
    a = rows.where("system_name = 'base-a'").select("id", "state", F.col("correct").alias("x"))
    b = rows.where("system_name = 'base-b'").select("id", F.col("correct").alias("y"))
    diff = a.join(b, "id").select(F.lit("base-a - base-b").alias("pair"), "state", (F.col("x") - F.col("y")).alias("correct"))
    return M.bootstrap_ci(diff, ["pair"], F.md5("state"))


def _gate(spark, d):
    rows = _ev(spark, d).where("kind = 'verify'").withColumn("p0", F.col("p")[0])
    return rows.select("system_name", "suite", "lang", "p0", F.col("gold").alias("harmful"))


def _gate_counts():
    missed, alarm = (F.col("harmful") == 1) & (F.col("p0") >= 0.5), (F.col("harmful") == 0) & (F.col("p0") < 0.5)
    return [F.count_if(F.col("harmful") == 1).alias("n_harmful"), F.count_if(missed).alias("missed"), F.count_if(F.col("harmful") == 0).alias("n_benign"), F.count_if(alarm).alias("false_alarms")]


def a25_gate_counts(spark, d):
    return _gate(spark, d).groupBy("system_name").agg(*_gate_counts())


def a26_rollup(spark, d):
    _gate(spark, d).createOrReplaceTempView("gate_rows")
    return spark.sql("""SELECT system_name, suite, lang, count_if(harmful = 1 AND p0 >= 0.5) AS missed, count_if(harmful = 0 AND p0 < 0.5) AS false_alarms, count(*) AS n
        FROM gate_rows GROUP BY GROUPING SETS ((system_name), (system_name, suite), (system_name, lang))""")


def a27_local_share(spark, d):
    sure = F.col("confidence") >= 0.75
    return _ev(spark, d).groupBy("system_name").agg(_r(F.avg(sure.cast("int")), "local_share"), _r(F.avg(F.when(sure, F.col("correct"))), "local_accuracy"))


def a28_missed_thresholds(spark, d):
    return _gate(spark, d).groupBy("system_name").agg(
        F.count_if((F.col("harmful") == 1) & (1 - F.col("p0") < 0.8)).alias("missed_high"), F.count_if((F.col("harmful") == 1) & (1 - F.col("p0") < 0.3)).alias("missed_low")
    )


def a37_agreement(spark, d):
    rows = _ev(spark, d)
    a = rows.where("system_name = 'base-a'").select("id", F.col("pred").alias("x"), F.col("p").alias("pa"))
    b = rows.where("system_name = 'base-b'").select("id", F.col("pred").alias("y"), F.col("p").alias("pb"))
    delta = F.array_max(F.zip_with("pa", "pb", lambda u, v: F.abs(u - v)))
    return a.join(b, "id").agg(_r(F.avg((F.col("x") == F.col("y")).cast("int")), "agreement"), _r(F.max(delta), "max_delta"), F.count(F.lit(1)).alias("n"))


def a38_selection(spark, d):
    """Mean accuracy over the suites that all systems scored; the best system is flagged."""
    s = _ev(spark, d).groupBy(*KEYS).agg(F.avg("correct").alias("x"))
    n = s.select("system_name").distinct().agg(F.count(F.lit(1)).alias("want"))
    common = s.groupBy("suite").agg(F.count(F.lit(1)).alias("got")).crossJoin(n).where("got = want").select("suite")  # n is one row
    means = s.join(common, "suite").groupBy("system_name").agg(F.round(F.avg("x"), 6).alias("score"))
    best = means.agg(F.max("score").alias("top"))
    return means.crossJoin(best).select("system_name", "score", (F.col("score") == F.col("top")).alias("best"))


def a39_pairwise_ece(spark, d):
    e = a04_ece15(spark, d)
    a, b = e.withColumnsRenamed({"system_name": "a", "ece": "ea"}), e.withColumnsRenamed({"system_name": "b", "ece": "eb"})
    return a.join(b, "suite").where("a < b").groupBy("a", "b").agg(_r(F.avg("ea"), "mean_a"), _r(F.avg("eb"), "mean_b"), F.count(F.lit(1)).alias("n_suites"))


def a41_holdout_by_kind(spark, d):
    """Accuracy, agreement with the teacher's choice and KL from the teacher, of hash-held-out examples against label smoothing."""
    ex = table(spark, d, "examples").where("probs IS NOT NULL AND size(probs) = n_choices")
    ex = ex.withColumn("t", A.renormalise(F.col("probs"))).withColumn("q", A.smooth_labels(F.col("n_choices"), F.col("gold")))
    return ex.groupBy("kind").agg(_r(F.avg((A.argmax_first(F.col("t")) == F.col("gold")).cast("int")), "agreement"), _r(F.avg(A.kl(F.col("t"), F.col("q"))), "kl"), F.count(F.lit(1)).alias("n"))


def a42_denominators(spark, d):
    z = table(spark, d, "preds").where("probs IS NOT NULL").select("system_name", "id", "scored_at", F.explode("probs").alias("z"))
    return z.groupBy("system_name", "id", "scored_at").agg(_r(F.sum(F.exp("z")), "denominator"))


def a45_checker_agreement(spark, d):
    rows = _texts(_ev(spark, d).where("system_name = 'base-a'"))
    return rows.groupBy("suite", "gold_text", "pred_text").agg(F.count(F.lit(1)).alias("n")).where("gold_text <> pred_text").orderBy(F.desc("n"), "suite", "gold_text", "pred_text").limit(10)


def j01_items_preds(spark, d):
    return _ev(spark, d).select("system_name", "id", "pred", F.round("top", 6).alias("top"))


def j04_common_suites(spark, d):
    s = _ev(spark, d).select(*KEYS).distinct()
    return s.where("system_name = 'base-a'").select("suite").intersect(s.where("system_name = 'base-b'").select("suite"))


def j05_suites_of_all(spark, d):
    s = _ev(spark, d).groupBy("suite").agg(F.countDistinct("system_name").alias("got"))
    n = table(spark, d, "preds").agg(F.countDistinct("system_name").alias("want"))
    return s.crossJoin(n).where("got = want").select("suite")


def item_hash():
    """sha256 of the compact JSON of [state, question, options, gold]."""
    one = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    return F.sha2(F.concat(F.lit("["), one(F.col("state")), F.lit(","), one(F.col("question")), F.lit(","), F.to_json("choices"), F.lit(","), F.coalesce(F.col("gold").cast("string"), F.lit("null")), F.lit("]")), 256)


def f29_item_hash(spark, d):
    return table(spark, d, "items").select("id", item_hash().alias("sha256"))


def j14_manifest_diff(spark, d):
    fields = ["suite", "split", "lang", "kind", "n_choices", "group_id", "perm"]
    have = table(spark, d, "items").withColumns({"n_choices": F.size("choices"), "sha256": item_hash()}).select("id", F.struct(*fields).alias("a"), F.col("sha256").alias("ha"))
    want = table(spark, d, "manifest").select("id", F.struct(*fields).alias("b"), F.col("sha256").alias("hb"))
    both = have.join(want, "id", "full_outer")
    state = F.when(F.col("ha").isNull(), "missing").when(F.col("hb").isNull(), "extra").when(F.col("ha") != F.col("hb"), "hash").when(~F.col("a").eqNullSafe(F.col("b")), "metadata").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def j16_two_runs(spark, d):
    """Two scorings of one (system, id): do their choices agree, and by how much do they differ."""
    p = table(spark, d, "preds").where("probs IS NOT NULL")
    two = p.groupBy("system_name", "id").agg(F.min_by("probs", "scored_at").alias("a"), F.max_by("probs", "scored_at").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1 AND size(a) = size(b)")
    return two.select("system_name", "id", (A.argmax_first(F.col("a")) == A.argmax_first(F.col("b"))).alias("same"), _r(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))), "delta"))


def j17_unknown_ids(spark, d):
    return table(spark, d, "preds").select("system_name", "id").distinct().join(table(spark, d, "items"), "id", "left_anti")


def u02_differences(spark, d):
    a, b = table(spark, d, "items").select("id"), table(spark, d, "manifest").select("id")
    return a.exceptAll(b).withColumn("side", F.lit("items")).unionByName(b.exceptAll(a).withColumn("side", F.lit("manifest")))


def u03_intersection(spark, d):
    return table(spark, d, "items").select("id").intersect(table(spark, d, "manifest").select("id"))


def e01_items_with_flips(spark, d):
    """Item set with an option-permuted copy of every evaluation item; ids stay unique."""
    items = table(spark, d, "items").where("group_id IS NULL").select("id", "choices", "gold", F.lit(None).cast("array<int>").alias("perm"))
    n = F.size("choices")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.sha1(F.concat("id", F.lit("|"), i.cast("string"))).alias("h"), i.alias("i"))))
    perm = F.transform(order, lambda o: o["i"])
    plain = F.sequence(F.lit(0), n - 1)
    # an order that changes nothing is turned by one
    perm = F.when((perm == plain) & (n > 1), F.concat(F.slice(plain, F.lit(2), n - 1), F.array(F.lit(0)))).otherwise(perm)
    flips = items.withColumn("perm", perm)
    flips = flips.select(F.concat("id", F.lit("#flip")).alias("id"), F.transform("perm", lambda i: F.get("choices", i)).alias("choices"), (F.array_position("perm", F.col("gold")) - 1).cast("int").alias("gold"), "perm")
    return items.unionByName(flips)


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "ajfue" and k[1:3].isdigit() and k[3:4] == "_"}

_BASE = """WITH latest AS (SELECT system_name, id, arg_max(probs, scored_at) AS probs FROM preds WHERE probs IS NOT NULL GROUP BY 1, 2),
alls AS (SELECT i.*, system_name, list_transform(probs, lambda x: x / list_sum(probs)) AS p FROM items i JOIN latest USING (id) WHERE len(probs) = len(choices) AND list_sum(probs) > 0),
sc AS (SELECT *, list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS top, (list_position(p, list_max(p)) - 1 = gold)::INT AS correct,
  list_sum(list_transform(p, lambda x, i: pow(x - CASE WHEN i - 1 = gold THEN 1.0 ELSE 0.0 END, 2))) AS brier, -ln(greatest(p[gold + 1], 1e-12)) AS nll,
  CASE WHEN len(p) = 1 THEN 1.0 ELSE least(1.0, greatest(0.0, (len(p) * list_max(p) - 1) / (len(p) - 1))) END AS confidence, choices[gold + 1] AS gold_text,
  choices[list_position(p, list_max(p))] AS pred_text FROM alls),
ev AS (SELECT * FROM sc WHERE split = 'eval' AND group_id IS NULL)
"""


def _ece_sql(bins, conf="top", low=False, source="ev", keys="system_name, suite"):
    b = f"ceil(round({conf} * {bins}, 9))"
    b = f"greatest(1, {b})" if low else b
    return f"""SELECT {keys}, round(sum(CASE WHEN bin >= 1 THEN abs(c - h) ELSE 0 END) / sum(n), 6) AS ece
      FROM (SELECT {keys}, {b} AS bin, count(*) AS n, sum({conf}) AS c, sum(correct) AS h FROM {source} GROUP BY ALL) GROUP BY ALL"""


_LABELS = """, lab AS (SELECT system_name, suite, label, sum(CASE WHEN g THEN hit ELSE 0 END) AS tp, sum(g::INT) AS n_gold, sum((NOT g)::INT) AS n_pred FROM (
  SELECT system_name, suite, gold_text AS label, true AS g, (gold_text = pred_text)::INT AS hit FROM ev UNION ALL SELECT system_name, suite, pred_text, false, 0 FROM ev) GROUP BY ALL)
"""
_NDCG = """, opt AS (SELECT system_name, suite, id, gold, p, unnest(p) AS x, unnest(range(len(p))) AS i FROM ev WHERE kind = 'rank'),
rk AS (SELECT *, row_number() OVER (PARTITION BY system_name, id ORDER BY x DESC, i) AS r FROM opt),
nd AS (SELECT system_name, suite, id, sum(CASE WHEN i = gold AND r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) AS ndcg, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) / max(len(p)) AS random FROM rk GROUP BY ALL)
"""
_FAM = ", fam AS (SELECT system_name, suite, split_part(suite, '/', 1) AS family, avg(correct) AS x, avg(1.0 / len(p)) AS b FROM ev GROUP BY ALL)"
_GATE = ", gate AS (SELECT system_name, suite, lang, p[1] AS p0, gold AS harmful FROM ev WHERE kind = 'verify')"
def _temp_sql(rounds: int = 3, steps: int = 64) -> str:
    """tfit: the temperature of each system, by the rounds of brackets."""
    sql = """, cal AS (SELECT system_name, p, gold FROM sc WHERE split = 'calib' AND group_id IS NULL AND kind <> 'rank'),
b0 AS (SELECT DISTINCT system_name, ln(0.01) AS lo, ln(100) AS hi FROM cal)"""
    for r in range(rounds):
        sql += f""",
e{r} AS (SELECT system_name, i, lo, hi, list_transform(p, lambda x: exp((ln(greatest(x, 1e-12)) - ln(greatest(list_max(p), 1e-12))) / exp(lo + (hi - lo) * i / {steps}.0))) AS e, gold FROM cal JOIN b{r} USING (system_name), range({steps + 1}) r(i)),
a{r} AS (SELECT system_name, lo, hi, i, round(avg(-ln(greatest(e[gold + 1] / list_sum(e), 1e-12))), 12) AS nll FROM e{r} GROUP BY ALL),
c{r} AS (SELECT system_name, lo, hi, arg_min(i, (nll, i)) AS i, min(nll) AS nll FROM a{r} GROUP BY ALL),
b{r + 1} AS (SELECT system_name, lo + (hi - lo) * greatest(i - 1, 0) / {steps}.0 AS lo, lo + (hi - lo) * least(i + 1, {steps}) / {steps}.0 AS hi FROM c{r})"""
    return sql + f""",
tfit AS (SELECT system_name, round(exp(lo + (hi - lo) * i / {steps}.0), 4) AS temperature, round(nll, 6) AS nll FROM c{rounds - 1})
"""


_TEMP = _temp_sql()
_HASH = "sha256('[' || coalesce(to_json(state), 'null') || ',' || coalesce(to_json(question), 'null') || ',' || to_json(choices) || ',' || coalesce(gold::VARCHAR, 'null') || ']')"
_G = "count(*) FILTER (WHERE harmful = 1 AND p0 >= 0.5) AS missed"
_FA = "count(*) FILTER (WHERE harmful = 0 AND p0 < 0.5) AS false_alarms"
_GOALS = ", goals AS (SELECT suite, choices[gold + 1] AS label, count(*) AS n_items FROM items WHERE split = 'eval' AND group_id IS NULL GROUP BY ALL), sys AS (SELECT DISTINCT system_name FROM preds)"



def _boot_sql(source: str, keys: str, draws: int = 1000, blocks: int = 4096) -> str:
    """The bootstrap's draws again: what a block counts is how many steps of the distribution function of Poisson(1) its number passes."""
    edges, edge, mass = [], 0.0, 0.36787944117144233
    for k in range(9):
        edge += mass
        edges.append(f"(u >= {edge!r})::INT")
        mass /= k + 1
    return f""", cell AS (SELECT {keys}, ('0x' || substr(md5('0:' || coalesce(md5(state), '')), 1, 8))::BIGINT % {blocks} AS block, sum(correct)::DOUBLE AS v, count(*) AS n FROM {source} GROUP BY ALL),
        drawn AS (SELECT {keys}, draw, v, n, ('0x' || substr(md5('0:' || draw || ':' || block), 1, 8))::BIGINT / 4294967296.0 AS u FROM cell, range(1, {draws + 1}) r(draw)),
        m AS (SELECT {keys}, draw, sum(t * v) / nullif(sum(t * n), 0) AS m FROM (SELECT *, {" + ".join(edges)} AS t FROM drawn) GROUP BY ALL),
        q AS (SELECT {keys}, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY ALL)
        SELECT * FROM (SELECT {keys}, round(avg(correct), 6) AS mean FROM {source} GROUP BY ALL) JOIN q USING ({keys})"""


SQL = {
    "a23_bootstrap_ci": _BASE + _boot_sql("ev", "system_name"),
    "a24_paired_difference": _BASE + ", df AS (SELECT 'base-a - base-b' AS pair, a.state, a.correct - b.correct AS correct FROM ev a JOIN ev b ON a.id = b.id AND a.system_name = 'base-a' AND b.system_name = 'base-b')" + _boot_sql("df", "pair"),
    "a01_accuracy": _BASE + "SELECT system_name, suite, round(avg(correct), 6) AS accuracy, count(*) AS n FROM ev GROUP BY ALL",
    "a02_brier": _BASE + "SELECT system_name, suite, round(avg(brier), 6) AS brier FROM ev GROUP BY ALL",
    "a03_nll": _BASE + "SELECT system_name, suite, round(avg(-ln(p[gold + 1] + 1e-12)), 6) AS nll_added, round(avg(nll), 6) AS nll_clipped FROM ev GROUP BY ALL",
    "a04_ece15": _BASE + _ece_sql(15),
    "a05_ece10": _BASE + _ece_sql(10),
    "a06_ece10_zero": _BASE + _ece_sql(10, "confidence", True),
    "a07_macro_f1": _BASE + _LABELS + "SELECT system_name, suite, round(avg(2 * tp / (n_gold + n_pred)), 6) AS f1 FROM lab WHERE n_gold > 0 GROUP BY ALL",
    "a08_macro_f1_union": _BASE + _LABELS + "SELECT system_name, suite, round(avg(2 * tp / (n_gold + n_pred)), 6) AS f1 FROM lab GROUP BY ALL",
    "a09_conservative_f1": _BASE + _LABELS + _GOALS + """SELECT system_name, suite, round(avg(2 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + coalesce(n_pred, 0) - coalesce(tp, 0) + coalesce(n_gold, 0) - coalesce(tp, 0) + n_items - coalesce(n_gold, 0))), 6) AS f1
        FROM (goals CROSS JOIN sys) LEFT JOIN lab USING (system_name, suite, label) GROUP BY ALL""",
    "a10_ndcg10": _BASE + _NDCG + "SELECT system_name, suite, round(avg(ndcg), 6) AS ndcg FROM nd GROUP BY ALL",
    "a11_random_ndcg": _BASE + _NDCG + "SELECT system_name, suite, round(avg(random), 6) AS random_ndcg FROM nd GROUP BY ALL",
    "a12_skill": _BASE + _NDCG + "SELECT system_name, suite, round(least(1, greatest(0, (avg(ndcg) - avg(random)) / (1 - avg(random)))), 6) AS skill FROM nd GROUP BY ALL",
    "a13_case_exact": _BASE + "SELECT system_name, suite, round(avg(ok), 6) AS case_exact, count(*) AS n_cases FROM (SELECT system_name, suite, md5(state), min(correct) AS ok FROM ev GROUP BY ALL) GROUP BY ALL",
    "a14_valid_groups": _BASE + """, grid AS (SELECT s.system_name, i.suite, i.id, md5(i.state) AS c FROM items i CROSS JOIN (SELECT DISTINCT system_name FROM preds) s WHERE i.split = 'eval' AND i.group_id IS NULL),
        cs AS (SELECT grid.system_name, grid.suite, c, bool_and(correct IS NOT NULL) AS good, coalesce(sum(correct), 0) AS r, count(*) AS n FROM grid LEFT JOIN ev ON ev.system_name = grid.system_name AND ev.id = grid.id GROUP BY ALL)
        SELECT system_name, suite, sum(good::INT)::BIGINT AS n_good, round(sum(CASE WHEN good THEN r ELSE 0 END) / sum(n), 6) AS score FROM cs GROUP BY ALL""",
    "a15_macro_by_lang": _BASE + "SELECT system_name, suite, round(avg(a), 6) AS macro_accuracy FROM (SELECT system_name, suite, lang, avg(correct) AS a FROM ev GROUP BY ALL) GROUP BY ALL",
    "a16_realised_quality": _BASE + "SELECT system_name, suite, round(avg(1 - abs(pred - gold) / (len(p) - 1)), 6) AS quality FROM ev WHERE kind = 'score' GROUP BY ALL",
    "a17_index": _BASE + _FAM + """SELECT system_name, round(100 * avg(x), 6) AS index, round(100 * avg(b), 6) AS chance_index, round(100 * avg(s), 6) AS balanced_skill
        FROM (SELECT system_name, family, avg(x) AS x, avg(b) AS b, avg(least(1, greatest(0, (x - b) / (1 - b)))) AS s FROM fam GROUP BY ALL) GROUP BY ALL""",
    "a18_family_mean": _BASE + _FAM + """, want AS (SELECT split_part(suite, '/', 1) AS family, count(DISTINCT suite) AS want FROM items WHERE split = 'eval' AND group_id IS NULL GROUP BY 1)
        SELECT system_name, family, CASE WHEN count(*) = max(want) THEN round(avg(x), 6) END AS mean FROM fam JOIN want USING (family) GROUP BY ALL""",
    "a19_flip_rate": _BASE + """SELECT f.system_name, f.suite, round(avg((f.perm[f.pred + 1] <> o.pred)::INT), 6) AS flip_rate, count(*) AS n FROM sc f JOIN ev o ON o.system_name = f.system_name AND o.id = f.group_id
        WHERE f.split = 'eval' AND f.group_id IS NOT NULL GROUP BY ALL""",
    "a20_coverage": _BASE + """, it AS (SELECT suite, count(*) AS n_items FROM items WHERE split = 'eval' AND group_id IS NULL GROUP BY 1)
        SELECT system_name, suite, count(*) AS n, max(n_items) AS n_items, round(count(*) / max(n_items), 6) AS coverage, median(len(p))::DOUBLE AS median_options FROM ev JOIN it USING (suite) GROUP BY ALL""",
    "a21_temperature": _BASE + _TEMP + "SELECT * FROM tfit",
    "a22_tempered_ece": _BASE + _TEMP + """, te AS (SELECT system_name, correct, 1 / list_sum(list_transform(p, lambda x: exp((ln(greatest(x, 1e-12)) - ln(greatest(list_max(p), 1e-12))) / temperature))) AS top FROM ev JOIN tfit USING (system_name) WHERE kind <> 'rank')
        """ + _ece_sql(15, source="te", keys="system_name"),
    "a25_gate_counts": _BASE + _GATE + f"SELECT system_name, count(*) FILTER (WHERE harmful = 1) AS n_harmful, {_G}, count(*) FILTER (WHERE harmful = 0) AS n_benign, {_FA} FROM gate GROUP BY ALL",
    "a26_rollup": _BASE + _GATE + f"SELECT system_name, suite, lang, {_G}, {_FA}, count(*) AS n FROM gate GROUP BY GROUPING SETS ((system_name), (system_name, suite), (system_name, lang))",
    "a27_local_share": _BASE + "SELECT system_name, round(avg((confidence >= 0.75)::INT), 6) AS local_share, round(avg(CASE WHEN confidence >= 0.75 THEN correct END), 6) AS local_accuracy FROM ev GROUP BY ALL",
    "a28_missed_thresholds": _BASE + _GATE + "SELECT system_name, count(*) FILTER (WHERE harmful = 1 AND 1 - p0 < 0.8) AS missed_high, count(*) FILTER (WHERE harmful = 1 AND 1 - p0 < 0.3) AS missed_low FROM gate GROUP BY ALL",
    "a37_agreement": _BASE + """SELECT round(avg((a.pred = b.pred)::INT), 6) AS agreement, round(max(list_max(list_transform(a.p, lambda x, i: abs(x - b.p[i])))), 6) AS max_delta, count(*) AS n
        FROM ev a JOIN ev b ON a.id = b.id AND a.system_name = 'base-a' AND b.system_name = 'base-b'""",
    "a38_selection": _BASE + """, s AS (SELECT system_name, suite, avg(correct) AS x FROM ev GROUP BY ALL), common AS (SELECT suite FROM s GROUP BY suite HAVING count(*) = (SELECT count(DISTINCT system_name) FROM s)),
        m AS (SELECT system_name, round(avg(x), 6) AS score FROM s JOIN common USING (suite) GROUP BY 1) SELECT system_name, score, score = (SELECT max(score) FROM m) AS best FROM m""",
    "a39_pairwise_ece": _BASE + ", e AS (" + _ece_sql(15) + """) SELECT a.system_name AS a, b.system_name AS b, round(avg(a.ece), 6) AS mean_a, round(avg(b.ece), 6) AS mean_b, count(*) AS n_suites
        FROM e a JOIN e b ON a.suite = b.suite AND a.system_name < b.system_name GROUP BY ALL""",
    "a41_holdout_by_kind": """WITH e AS (SELECT kind, gold, n_choices, list_transform(probs, lambda x: x / list_sum(probs)) AS t, list_transform(range(n_choices), lambda i: CASE WHEN n_choices = 1 THEN 1.0 WHEN i = gold THEN 0.92 ELSE 0.08 / (n_choices - 1) END) AS q
        FROM examples WHERE probs IS NOT NULL AND len(probs) = n_choices AND list_sum(probs) > 0)
        SELECT kind, round(avg((list_position(t, list_max(t)) - 1 = gold)::INT), 6) AS agreement, round(avg(list_sum(list_transform(t, lambda a, i: a * (ln(greatest(a, 1e-12)) - ln(greatest(q[i], 1e-12)))))), 6) AS kl, count(*) AS n FROM e GROUP BY kind""",
    "a42_denominators": "SELECT system_name, id, scored_at, round(list_sum(list_transform(probs, lambda x: exp(x))), 6) AS denominator FROM preds WHERE probs IS NOT NULL AND len(probs) > 0",
    "a45_checker_agreement": _BASE + "SELECT suite, gold_text, pred_text, count(*) AS n FROM ev WHERE system_name = 'base-a' AND gold_text <> pred_text GROUP BY ALL ORDER BY n DESC, suite, gold_text, pred_text LIMIT 10",
    "j01_items_preds": _BASE + "SELECT system_name, id, pred, round(top, 6) AS top FROM ev",
    "j04_common_suites": _BASE + "SELECT suite FROM ev WHERE system_name = 'base-a' INTERSECT SELECT suite FROM ev WHERE system_name = 'base-b'",
    "j05_suites_of_all": _BASE + "SELECT suite FROM ev GROUP BY suite HAVING count(DISTINCT system_name) = (SELECT count(DISTINCT system_name) FROM preds)",
    "f29_item_hash": f"SELECT id, {_HASH} AS sha256 FROM items",
    "j14_manifest_diff": f"""SELECT CASE WHEN i.id IS NULL THEN 'missing' WHEN m.id IS NULL THEN 'extra' WHEN i.h <> m.sha256 THEN 'hash'
        WHEN (i.suite, i.split, i.lang, i.kind, i.n, i.group_id, i.perm) IS DISTINCT FROM (m.suite, m.split, m.lang, m.kind, m.n_choices, m.group_id, m.perm) THEN 'metadata' ELSE 'same' END AS state, count(*) AS n
        FROM (SELECT *, len(choices)::INT AS n, {_HASH} AS h FROM items) i FULL OUTER JOIN manifest m ON i.id = m.id GROUP BY 1""",
    "j16_two_runs": """SELECT system_name, id, list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same, round(list_max(list_transform(a, lambda x, i: abs(x - b[i]))), 6) AS delta
        FROM (SELECT system_name, id, arg_min(probs, scored_at) AS a, arg_max(probs, scored_at) AS b, count(*) AS n FROM preds WHERE probs IS NOT NULL GROUP BY ALL) WHERE n > 1 AND len(a) = len(b)""",
    "j17_unknown_ids": "SELECT DISTINCT system_name, id FROM preds WHERE id NOT IN (SELECT id FROM items)",
    "u02_differences": "SELECT id, 'items' AS side FROM items WHERE id NOT IN (SELECT id FROM manifest) UNION ALL SELECT id, 'manifest' FROM manifest WHERE id NOT IN (SELECT id FROM items)",
    "u03_intersection": "SELECT id FROM items INTERSECT SELECT id FROM manifest",
    "e01_items_with_flips": """WITH o AS (SELECT id, choices, gold FROM items WHERE group_id IS NULL),
        q AS (SELECT *, list_transform(list_sort(list_transform(range(len(choices)), lambda i: sha1(id || '|' || i) || '|' || i)), lambda x: split_part(x, '|', 2)::INT) AS pm FROM o),
        z AS (SELECT *, CASE WHEN pm = list_transform(range(len(choices)), lambda x: x::INT) AND len(choices) > 1 THEN list_append(list_transform(range(1, len(choices)), lambda x: x::INT), 0) ELSE pm END AS perm FROM q)
        SELECT id, choices, gold, NULL::INT[] AS perm FROM o UNION ALL SELECT id || '#flip', list_transform(perm, lambda i: choices[i + 1]), (list_position(perm, gold) - 1)::INT, perm FROM z""",
}
