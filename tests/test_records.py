"""Ranks in groups of any size, and texts that stand inside others."""

import pytest
from pyspark.sql import functions as F

from sievework.operators.hash_rank import hash_rank


@pytest.mark.parametrize("few", [False, True])
def test_hash_rank(spark, few):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") % 7).alias("w"))
    got = hash_rank(df.withColumn("k", F.when(F.col("k") > 0, F.col("k"))), "k", "id", "w", per_bucket=50, few_keys=few).toPandas()
    for _, part in got.groupby("k", dropna=False):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
        assert (part.before == part.w.cumsum() - part.w).all()


def test_contained_and_command_overlap(spark):
    from sievework.operators.selection import command_overlap, contained

    e = spark.createDataFrame([(1, "rm -rf the/whole/build folder"), (2, "averyveryverylongsinglecommand"), (3, "longfirstword secondword"), (4, "short one"), (5, None), (6, "echo one two three four five")], "id int, text string")
    t = spark.createDataFrame(
        [(10, "sudo rm -rf the/whole/build folders now"), (11, "x/averyveryverylongsinglecommand/y"), (12, "alongfirstword secondwords"), (13, "short one"), (14, "five echo one two three four"), (15, ""), (16, None)], "id int, text string"
    )
    assert {tuple(r) for r in contained(e, t).collect()} == {(1, 10), (2, 11), (3, 12)}
    assert {tuple(r) for r in command_overlap(e, t, "id", "text").collect()} == {(1, 10), (2, 11), (3, 12), (6, 14)}
    assert command_overlap(e.limit(0), t, "id", "text").collect() == []
