"""Records that differ only in layout: white space, case, punctuation, order of fields or options.

Texts stream through a skip-and-fold table into rolling polynomial hashes; members of a JSON state and options are summed,
so their order doesn't matter. Rows of equal hash are compared by pointers that run over both raw texts and jump over what
folding skips. No canonical text is ever put together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk
from sievework.operators.key_filter import likely_in
from sievework.session import stage

STATE, MEMBER, QUESTION, CHOICE, NO_STATE, NO_QUESTION, NO_LIST, NO_CHOICE = range(8)
PARTS = ("state", "question", "choices")
NOT_BLANK = r"[^\p{Z}\s\x85\x1c-\x1f]"
#: So many symbols of each pair of texts are compared before the pointers move on.
STRIDE = 1024


def _member(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _pieces(batch: pa.RecordBatch, suffix: str = "") -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, row, kind, mate) of everything a batch's records consist of. A member of a JSON state is two texts, its key
    and its value: mate is the place of the value's text for the key, -1 for texts that stand alone, -2 for values."""
    texts: list[str] = []
    row: list[int] = []
    kind: list[int] = []
    mate: list[int] = []

    def put(i: int, k: int, text: str, m: int = -1) -> None:
        texts.append(text)
        row.append(i)
        kind.append(k)
        mate.append(m)

    for i, state in enumerate(batch.column("state" + suffix).to_pylist()):
        if state is not None and state.lstrip()[:1] == "{":
            try:
                members = json.loads(state)
            except (ValueError, RecursionError):
                members = None
            if isinstance(members, dict):
                for k, v in members.items():
                    put(i, MEMBER, k, len(texts) + 1)
                    put(i, MEMBER, _member(v), -2)
                continue
        put(i, NO_STATE if state is None else STATE, state or "")
    for i, q in enumerate(batch.column("question" + suffix).to_pylist()):
        put(i, NO_QUESTION if q is None else QUESTION, q or "")
    for i, choices in enumerate(batch.column("choices" + suffix).to_pylist()):
        if choices is None:
            put(i, NO_LIST, "")
        for c in choices or ():
            put(i, NO_CHOICE if c is None else CHOICE, c or "")
    return pa.array(texts, pa.large_string()), np.array(row), np.array(kind), np.array(mate)


class Side:
    """The pieces of one side's records with the hash of each: symbols are the raw texts' code points looked up in the
    skip-and-fold table, 0 where one is skipped."""

    def __init__(self, batch: pa.RecordBatch, suffix: str = ""):
        texts, self.row, self.kind, self.mate = _pieces(batch, suffix)
        cps, self.offs = tk.codepoints(texts)
        self.symbols = tk.fold()[cps]
        rolling = tk.Rolling(self.symbols, 7, skip=True)
        self.rank = rolling.rank
        h = rolling.of(self.offs[:-1], self.offs[1:])
        with np.errstate(over="ignore"):
            keys = np.flatnonzero(self.mate >= 0)
            h[keys] = tk.mix(h[keys] * np.uint64(3) + h[self.mate[keys]])
            h = tk.mix(h + self.kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        h[self.mate == -2] = 0
        self.hash = h

    def in_order(self) -> np.ndarray:
        """The pieces of each row in the order of their hashes, a value after its key."""
        own = np.flatnonzero(self.mate != -2)
        own = own[np.lexsort((self.hash[own], self.kind[own], self.row[own]))]
        order = np.stack([own, np.where(self.mate[own] >= 0, self.mate[own], -1)], 1).ravel()
        return order[order >= 0]

    def stops(self) -> np.ndarray:
        """Where a pointer that jumps over skipped symbols may stand."""
        return np.flatnonzero(self.symbols)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "state"):
            side = Side(batch)
            key = np.zeros(batch.num_rows, np.uint64)
            with np.errstate(over="ignore"):
                np.add.at(key, side.row, side.hash)
            yield pa.record_batch([batch.column("id"), pa.array(tk.mix(key).view(np.int64))], ["id", "key"])


def same_records(batch: pa.RecordBatch, stride: int = STRIDE) -> np.ndarray:
    """Whether the two records of each row are the same: their pieces are paired in the order of their hashes, and over every
    pair two pointers run in step, each to the next symbol that isn't skipped, `stride` symbols at a time and all pairs of
    the batch together. A row is given up at its first difference."""
    a, b = Side(batch, "_a"), Side(batch, "_b")
    order_a, order_b = a.in_order(), b.in_order()
    n = batch.num_rows
    same = np.bincount(a.row[order_a], minlength=n) == np.bincount(b.row[order_b], minlength=n)
    pa_, pb = order_a[same[a.row[order_a]]], order_b[same[b.row[order_b]]]
    rows = a.row[pa_]
    at_a, at_b = a.rank[a.offs[pa_]], b.rank[b.offs[pb]]
    left, other = a.rank[a.offs[pa_ + 1]] - at_a, b.rank[b.offs[pb + 1]] - at_b
    same[rows[(left != other) | (a.kind[pa_] != b.kind[pb])]] = False
    stops_a, stops_b = a.stops(), b.stops()
    open_ = np.flatnonzero(same[rows] & (left > 0))
    while len(open_):
        size = np.minimum(left[open_], stride)
        x, y = (s.symbols[stops[tk.gather(at[open_], size)]] for s, stops, at in ((a, stops_a, at_a), (b, stops_b, at_b)))
        same[np.repeat(rows[open_], size)[x != y]] = False
        at_a[open_] += size
        at_b[open_] += size
        left[open_] -= size
        open_ = open_[(left[open_] > 0) & same[rows[open_]]]
    return same


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "state_b"):
            yield pa.record_batch([batch.column("rep"), batch.column("id_b"), batch.column("key"), pa.array(same_records(batch))], ["rep", "id", "key", "same"])


def layout_duplicates(df: DataFrame, id_col: str, state: str = "state", question: str = "question", choices: str = "choices") -> DataFrame:
    """(rep, id): each record with several rows, its smallest id paired with each of the others.

    Same record: question and options (in any order) agree after folding, and the states agree after folding, or, where both
    parse as JSON objects, their members do in any order (a value that isn't text counts as its JSON text).
    Null and blank states are left out; a null question, list or option equals only another null; rows without an
    id are left out, and a row that repeats an id adds nothing. Lower case is taken letter by letter. An empty table gives no rows; other columns are ignored.

    Plan: one pass to (id, 64-bit key) and a partially aggregated count per key; then the texts of the rows in question alone
    are fetched, by a bounded filter of their ids before the shuffle, staged once, and each compared with its key's
    representative. Rows whose key is equal by chance are compared among themselves in another round; a round settles at
    least one row of every such key. A key that holds a third of all rows is pre-aggregated before its shuffle, and
    the join to its one representative is split by adaptive skew handling.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(state).alias("state"), F.col(question).alias("question"), F.col(choices).alias("choices"))
    rows = rows.where(F.col("id").isNotNull() & F.col("state").isNotNull() & F.col("state").rlike(NOT_BLANK))
    kind = rows.schema["id"].dataType.simpleString()
    keys = stage(rows.mapInArrow(_keys, f"id {kind}, key bigint"), "record-keys")
    groups = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = stage(keys.join(groups, "key").select("id", "key", "rep").distinct(), "record-wanted")
    texts = stage(likely_in(rows, "id", wanted.select("id")).join(wanted, "id"), "record-texts")
    found = None
    while True:
        reps = texts.where("id = rep").dropDuplicates(["key", "rep"]).select("key", "rep", *[F.col(c).alias(f"{c}_a") for c in PARTS])
        rest = texts.where("id <> rep").select("key", "rep", F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in PARTS])
        checked = stage(rest.join(reps, ["key", "rep"]).mapInArrow(_verify, f"rep {kind}, id {kind}, key bigint, same boolean"), "record-pairs")
        good = checked.where("same").select("rep", "id")
        found = good if found is None else found.unionByName(good)
        odd = checked.where("not same").select("id", "key").distinct()
        if odd.isEmpty():
            return found.distinct()
        first = odd.groupBy("key").agg(F.min("id").alias("rep"))
        texts = stage(texts.drop("rep").join(odd.join(first, "key"), ["id", "key"]), "record-texts")


def record_counts(df: DataFrame, id_col: str, **columns: str) -> DataFrame:
    """(rep, copies): each record once, by its smallest id, with the number of its rows (1 for a single one)."""
    state = columns.get("state", "state")
    base = df.where(F.col(state).isNotNull() & F.col(state).rlike(NOT_BLANK)).select(F.col(id_col).alias("id"))
    pairs = layout_duplicates(df, id_col, **columns)
    return base.join(pairs, "id", "left").groupBy(F.coalesce("rep", "id").alias("rep")).agg(F.count(F.lit(1)).alias("copies"))
