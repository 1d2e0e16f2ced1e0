"""Rows whose key may be among wanted ones: a Bloom filter of bounded size, applied before a table is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a wanted key, probes of a key, and the most bits of a filter (32 MB).
PER_KEY, PROBES, MOST = 10, 4, 1 << 28


def _places(key: str, bits: int) -> list[Column]:
    h = F.xxhash64(F.lit(7), F.col(key))
    first, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(first + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def _with_filter(df: DataFrame, key: str, wanted: DataFrame, most: int) -> tuple[DataFrame, Column] | None:
    """df with the filter beside each row, and whether a row passes; None where about half of all rows would."""
    n = wanted.count()
    bits = 1 << 13
    while bits < min(PER_KEY * n, most):
        bits *= 2
    if PROBES * n > 2 * bits:
        return None
    spots = wanted.select(F.explode(F.array(*_places(key, bits))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS INT))")).alias("b"))
    table = np.zeros(bits // 64, np.int64)
    for r in words.toArrow().to_batches():
        table[r.column("w").to_numpy()] = r.column("b").to_numpy()
    one = df.sparkSession.createDataFrame(pa.table({"_bits": pa.array([table], pa.list_(pa.int64()))}))
    hit = None
    for p in _places(key, bits):
        word = F.get("_bits", F.shiftright(p, 6).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        hit = bit if hit is None else hit & bit
    return df.crossJoin(F.broadcast(one)), hit


def likely_in(df: DataFrame, key: str, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """df without most rows whose key is not in the column of that name of wanted, a table that is cheap to read twice. Every
    wanted row stays, some others do too: the exact semi-join comes after, on what is left. The filter has PER_KEY bits a
    wanted key, at most `most`: so what is broadcast is bounded, and with very many wanted keys more rows pass. Where it would
    let through about half of all, df is returned as it is. Results of the later join are the same in any case."""
    made = _with_filter(df, key, wanted, most)
    return df if made is None else made[0].where(made[1]).drop("_bits")


def rows_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in wanted, of a table too wide to be shuffled whole. wanted holds each key once, in one column: an
    inner join then, as the optimiser would move a semi-join below the filter."""
    return likely_in(df, key, wanted).join(wanted, key)


def rows_not_in(df: DataFrame, key: str, unwanted: DataFrame, most: int = MOST) -> DataFrame:
    """The rows whose key is not in unwanted, of a table that is cheap to read twice: what the filter rules out stays where it
    is, only the others are shuffled for the exact anti-join."""
    made = _with_filter(df, key, unwanted, most)
    if made is None:
        return df.join(unwanted, key, "left_anti")
    beside, hit = made
    sure = beside.where(~hit | F.col(key).isNull()).drop("_bits")
    return sure.unionByName(beside.where(hit).drop("_bits").join(unwanted, key, "left_anti"))
