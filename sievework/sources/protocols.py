"""Item loaders: one function a protocol of evaluation data, each from a raw table to the columns of an item set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T

COLUMNS = ("id", "kind", "state", "question", "choices", "gold", "split")


def part_of(key: Column, calib: float = 0.2) -> Column:
    """eval or calib, by a hash of the id."""
    return F.when(T.md5_bucket("part", key.cast("string")) < calib, "calib").otherwise("eval")


def _items(df: DataFrame, id_: Column, kind: str, state: Column, question: Column, choices: Column, gold: Column, calib: float) -> DataFrame:
    """Rows without a state or with a gold option out of range are left out."""
    made = df.select(id_.cast("string").alias("id"), F.lit(kind).alias("kind"), state.alias("state"), question.alias("question"), choices.alias("choices"), gold.cast("int").alias("gold"), part_of(id_, calib).alias("split"))
    return made.where(F.col("state").isNotNull() & (F.trim("state") != "") & F.col("gold").between(0, F.size("choices") - 1))


def pair_items(df: DataFrame, id_: Column, premise: Column, hypothesis: Column, label: Column, labels: list[str], question: str, calib: float = 0.2) -> DataFrame:
    """Two texts and how the second follows from the first; labels are the options, label the place of the right one."""
    state = F.format_string("Premise: %s\nHypothesis: %s", premise, hypothesis)
    return _items(df.where(premise.isNotNull() & hypothesis.isNotNull()), id_, "choose", state, F.lit(question), F.array(*map(F.lit, labels)), label, calib)


def labelled_items(df: DataFrame, id_: Column, text: Column, label: Column, names: list[str], question: str, calib: float = 0.2) -> DataFrame:
    """A text and the name of its class, among all names."""
    options = F.array(*[F.lit(pretty(n)) for n in names])
    place = F.array_position(F.array(*map(F.lit, names)), label).cast("int") - 1
    return _items(df.where(label.isNotNull()), id_, "choose", text, F.lit(question), options, place, calib)


def pretty(name: str) -> str:
    return " ".join(w for w in name.replace("_", " ").replace(".", " ").replace("-", " ").split())


def binary_items(df: DataFrame, id_: Column, text: Column, yes: Column, question: str, calib: float = 0.2) -> DataFrame:
    """A text and a statement that holds or not."""
    return _items(df.where(yes.isNotNull()), id_, "verify", text, F.lit(question), F.array(F.lit("yes"), F.lit("no")), F.when(yes, 0).otherwise(1), calib)


def scored_items(df: DataFrame, id_: Column, text: Column, score: Column, levels: list[str], low: float, high: float, question: str, calib: float = 0.2) -> DataFrame:
    """A text and a number, put on ordered levels between low and high."""
    n = len(levels)
    level = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((score - low) / ((high - low) / n))))
    return _items(df.where(score.isNotNull()), id_, "score", text, F.lit(question), F.array(*map(F.lit, levels)), level, calib)


def ranked_items(df: DataFrame, query: Column, candidate: Column, relevance: Column, order: Column, most: int = 50, calib: float = 0.2) -> DataFrame:
    """Candidates of one query as the options of an item, in an order; gold is the first most relevant one. An item holds at most
    `most` candidates, the first in order, kept before any list is built."""
    from pyspark.sql import Window

    rows = df.where(query.isNotNull() & candidate.isNotNull()).select(query.alias("q"), candidate.alias("c"), relevance.cast("int").alias("r"), order.alias("o"))
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("o"))).where(F.col("k") <= most)
    item = few.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("o", "c", "r"))).alias("l")).where(F.size("l") > 1)
    rel = F.transform("l", lambda x: x["r"])
    return _items(item, F.md5("q"), "rank", F.col("q"), F.lit("Which of these answers the query?"), F.transform("l", lambda x: x["c"]), F.array_position(rel, F.array_max(rel)) - 1, calib)
