"""Bounded filters and rarity tables: nothing wanted is lost, and no corpus is too large for the scale."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk
from sievework.operators.key_filter import likely_in, rows_in, rows_not_in
from sievework.operators.selection import cap_per, near_duplicates
from sievework.operators.word_rarity import BUCKETS, STEPS, bucket, prefix_length, word_rarity


@pytest.mark.parametrize("most", [64, 1 << 13, 1 << 28])
def test_no_wanted_row_is_lost(spark, most):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("text").alias("text"))
    wanted = df.where("k % 17 = 3").select("k")
    got = {r["k"] for r in likely_in(df, "k", wanted, most).select("k").collect()}
    assert got >= set(range(3, 20_000, 17))
    assert most < 100 or len(got) < 2_000
    assert {r["k"] for r in rows_in(df, "k", wanted).collect()} == set(range(3, 20_000, 17))
    assert rows_in(df, "k", wanted.limit(0)).count() == 0 and rows_in(df.limit(0), "k", wanted).count() == 0


@pytest.mark.parametrize("most", [64, 1 << 28])
def test_only_unwanted_rows_are_lost(spark, most):
    df = spark.range(5_000).select(F.when(F.col("id") > 3, F.col("id")).alias("k"), F.lit("text").alias("text"))
    gone = df.where("k % 7 = 3").select("k")
    got = rows_not_in(df, "k", gone, most)
    assert {r["k"] for r in got.collect()} == {None} | {k for k in range(4, 5_000) if k % 7 != 3} and got.count() == 5_000 - gone.count()
    assert rows_not_in(df, "k", gone.limit(0), most).count() == 5_000


def test_filter_by_text_and_null(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("ü" * 9, 3), ("", 4)], "k string, v int")
    wanted = spark.createDataFrame([("a",), ("",), ("ü" * 9,)], "k string")
    assert {r["v"] for r in rows_in(df, "k", wanted).collect()} == {1, 3, 4}


def test_rarity_keeps_common_words_apart(spark):
    df = spark.createDataFrame([("aa " * 1000 + "bb " * 100 + "cc",), (None,), ("",)], "text string")
    r = word_rarity(df)
    cps, offs = tk.codepoints(__import__("pyarrow").array(["aa bb cc"]))
    h = tk.word_hashes(cps, *tk.words(cps, offs)[:2])
    a, b, c = r[bucket(h)]
    assert a > b > c == STEPS and np.log2(2.0**63) * STEPS < 1 << 16 and len(r) == BUCKETS
    assert word_rarity(df.limit(0)).sum() == 0
    lists = word_rarity(spark.createDataFrame([(["x", "y"],), (["x"],), (None,), ([],)], "text array<string>"))
    assert sorted(lists[lists > 0]) == [STEPS, int(np.log2(3) * STEPS)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, sorted(rng.sample([f"t{k}" for k in range(40)], rng.randint(3, 12)))) for i in range(120)]
    rows += [(200 + i, sorted({*s[:-1], "t0"})) for i, (_, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, s array<string>")
    left, right = df.where("id < 200"), df.where("id >= 200")
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates(left, right, "id", "s").collect()}
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, a in rows if i < 200 and len(a) >= 5 for j, b in rows if j >= 200 and len(b) >= 5 and sim(a, b) >= 0.8}
    assert got == want and want
    assert near_duplicates(left, right.limit(0), "id", "s").collect() == []


def test_prefix_is_enough():
    for n in range(1, 60):
        p = int(prefix_length(np.array([n]), 0.8)[0])
        assert p == n - int(np.ceil(0.8 * n - 1e-9)) + 1


def test_cap_per_takes_the_first_by_hash(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.col("id").cast("string")).alias("k"))
    got = cap_per(df, ["k"], 7, "id")
    order = df.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(0), "id"), 1)).where("k = 'hot'").orderBy("h", "id").limit(7)
    assert {r["id"] for r in got.where("k = 'hot'").collect()} == {r["id"] for r in order.collect()}
    assert got.where("k IS NULL").count() == min(7, df.where("k IS NULL").count()) and got.groupBy("k").count().where("count > 7").count() == 0
