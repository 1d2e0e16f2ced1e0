"""Scoring predictions against items: one row-level table, then grouped aggregates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.session import stage


def latest_predictions(preds: DataFrame) -> DataFrame:
    """The last prediction of each (system, id). A partially aggregated maximum instead of a window, so no key is sorted."""
    return preds.where("probs IS NOT NULL").groupBy("system_name", "id").agg(F.max_by("probs", "scored_at").alias("probs"))


def scored(items: DataFrame, preds: DataFrame) -> DataFrame:
    """Items with their last prediction, renormalised: one row a (system, item) that was answered validly (as many
    probabilities as options, with a positive sum), with pred, top, correct, brier, nll and confidence."""
    rows = items.join(latest_predictions(preds), "id").where(F.size("probs") == F.size("choices"))
    rows = rows.withColumn("p", A.renormalise(F.col("probs"))).where("p IS NOT NULL")
    p, gold = F.col("p"), F.col("gold")
    return rows.withColumns({"pred": A.argmax_first(p), "top": F.array_max(p), "brier": A.brier(p, gold), "nll": A.nll(p, gold), "confidence": A.confidence(p)}).withColumn(
        "correct", (F.col("pred") == gold).cast("int")
    )


def evaluated(items: DataFrame, preds: DataFrame) -> DataFrame:
    """scored, without flip copies, of the evaluation split."""
    return scored(items.where("split = 'eval' AND group_id IS NULL"), preds)


def ece(rows: DataFrame, keys: list[str], bins: int = 15, conf: str = "top", hit: str = "correct", zero_in_first: bool = False) -> DataFrame:
    """(keys, ece): expected calibration error with bins (lo, hi]. A confidence of 0 falls in no bin, or in the first one."""
    b = F.ceil(F.round(F.col(conf) * bins, 9))
    b = F.greatest(F.lit(1), b) if zero_in_first else b
    cells = rows.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(conf).alias("c"), F.sum(hit).alias("h"))
    gap = F.when(F.col("bin") >= 1, F.abs(F.col("c") - F.col("h"))).otherwise(0.0)
    return cells.groupBy(*keys).agg(F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"))


def label_counts(rows: DataFrame, keys: list[str], gold: Column, pred: Column) -> DataFrame:
    """(keys, label, tp, n_gold, n_pred) for all labels that are gold or predicted; partial counts only, no self-join."""
    each = rows.select(*keys, gold.alias("g"), pred.alias("p"))
    sides = F.array(F.struct(F.col("g").alias("label"), F.lit(1).alias("as_gold")), F.struct(F.col("p").alias("label"), F.lit(0).alias("as_gold")))
    long = each.select(*keys, F.explode(sides).alias("s"), (F.col("g") == F.col("p")).cast("int").alias("hit"))
    return long.groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum(F.col("s.as_gold") * F.col("hit")).alias("tp"), F.sum("s.as_gold").alias("n_gold"), F.sum(1 - F.col("s.as_gold")).alias("n_pred")
    )


def macro_f1(rows: DataFrame, keys: list[str], gold: Column, pred: Column, union: bool = False) -> DataFrame:
    """(keys, f1): mean F1 over the labels that are gold, or, with union, also over those only predicted."""
    counts = label_counts(rows, keys, gold, pred)
    counts = counts if union else counts.where("n_gold > 0")
    return counts.groupBy(*keys).agg(F.round(F.avg(2 * F.col("tp") / (F.col("n_gold") + F.col("n_pred"))), 6).alias("f1"))


def temperature_fit(rows: DataFrame, keys: list[str], low: float = 0.01, high: float = 100.0, rounds: int = 3, steps: int = 64) -> DataFrame:
    """(keys, temperature, nll): the T between low and high with the least mean NLL of softmax(ln p / T), which has one minimum in
    ln T. Each round tries steps + 1 places of the bracket that is left and keeps the two steps around the best: three rounds
    leave a thirty-thousandth of it. The sums per place are plain partial aggregates, so no task sees a whole group."""
    each = stage(rows.select(*keys, "p", "gold"), "calibration")
    bracket = each.select(*keys).distinct().withColumns({"lo": F.ln(F.lit(low)), "hi": F.ln(F.lit(high))})
    place = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / float(steps)
    for _ in range(rounds):
        tried = each.join(bracket, keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        nll = F.avg(A.nll(A.temper(F.col("p"), F.exp(place(F.col("i")))), F.col("gold")))
        sums = tried.groupBy(*keys, "lo", "hi", "i").agg(F.round(nll, 12).alias("nll"))
        best = sums.groupBy(*keys, "lo", "hi").agg(F.min(F.struct("nll", "i")).alias("b")).select(*keys, "lo", "hi", "b.nll", "b.i")
        best = stage(best, "temperature")
        bracket = best.select(*keys, place(F.greatest(F.col("i") - 1, F.lit(0))).alias("lo"), place(F.least(F.col("i") + 1, F.lit(steps))).alias("hi"))
    return best.select(*keys, F.round(F.exp(place(F.col("i"))), 4).alias("temperature"), F.round("nll", 6).alias("nll"))


def bootstrap_ci(rows: DataFrame, keys: list[str], cluster: Column, value: str = "correct", draws: int = 1000, seed: int = 0, blocks: int = 4096) -> DataFrame:
    """(keys, mean, low, high): a 95 % interval over clusters by the Poisson bootstrap, each cluster counting as often as a
    Poisson(1) number hashed from (seed, draw, block) says. Clusters fold into at most `blocks` hash blocks first, so the
    draws multiply a bounded table; with fewer clusters than blocks nearly every block is one cluster."""
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
    block = number(F.concat(F.lit(f"{seed}:"), F.coalesce(cluster.cast("string"), F.lit("")))) % blocks
    cells = rows.groupBy(*keys, block.alias("block")).agg(F.sum(value).cast("double").alias("v"), F.count(F.lit(1)).alias("n"))
    drawn = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = number(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("block").cast("string"))) / F.lit(4294967296.0)
    times, edge, mass = F.lit(0), 0.0, 0.36787944117144233
    for k in range(9):  # the distribution function of Poisson(1)
        edge += mass
        times = times + (u >= edge).cast("int")
        mass /= k + 1
    sums = drawn.withColumn("times", times).groupBy(*keys, "draw").agg(F.sum(F.col("times") * F.col("v")).alias("v"), F.sum(F.col("times") * F.col("n")).alias("n"))
    stats = sums.withColumn("m", F.try_divide("v", "n")).groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    mean = rows.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"))
    return mean.join(stats, keys).select(*keys, "mean", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))
