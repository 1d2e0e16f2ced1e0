"""Ranks in hash order within groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, key: str, id_col: str, weight: str | None = None, seed: int = 0, per_bucket: int = 2000, few_keys: bool = False) -> DataFrame:
    """df with `rank` (from 1, in the order of a seeded hash of id_col, then id_col, within key) and, with a weight column,
    `before`: the summed weight of the earlier rows.

    The hash range of a key is cut into as many buckets as keep about per_bucket rows each. Counts per bucket give each
    bucket's offset; only the order inside a bucket needs a window. Neither the keys nor the rows of a key are bounded;
    few_keys says that the caller bounds the keys, whose sizes are broadcast then. Null keys form a key of their own.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") / F.lit(float(1 << 53))
    k = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    rows = df.withColumn("_k", k).withColumn("_u", u)
    sizes = rows.groupBy("_k").agg(F.ceil(F.count(F.lit(1)) / per_bucket).alias("_buckets"))
    rows = rows.join(F.broadcast(sizes) if few_keys else sizes, "_k").withColumn("_bucket", F.floor(F.col("_u") * F.col("_buckets")))
    w = F.col(weight) if weight else F.lit(0)
    counts = rows.groupBy("_k", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    earlier = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_k", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy("_k", "_bucket").orderBy("_u", id_col)
    ranked = rows.withColumn("_r", F.row_number().over(inside))
    if weight:
        ranked = ranked.withColumn("_b", F.coalesce(F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(offsets, ["_k", "_bucket"]).withColumn("rank", F.col("_n0") + F.col("_r"))
    if weight:
        ranked = ranked.withColumn("before", F.col("_w0") + F.col("_b")).drop("_b")
    return ranked.drop("_k", "_u", "_buckets", "_bucket", "_n0", "_w0", "_r")
