"""A fixed-size estimate of how common each word is, the same order for all users of it, and the prefix filters built on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk

BUCKETS = 1 << 18
#: Steps of a rarity for each doubling of the count; a rarity is below 64 STEPS, however large the corpus.
STEPS = 1024


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def member_hashes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every member of a column of lists of texts."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cps, offs = tk.codepoints(lists.flatten())
    return tk.Rolling(cps, 3).of(offs[:-1], offs[1:]), np.repeat(np.arange(len(lists)), n)


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    if pa.types.is_list(batch.column(0).type):
        return member_hashes(batch.column(0))[0]
    cps, offs = tk.codepoints(batch.column(0))
    start, end, _ = tk.words(cps, offs)
    return tk.word_hashes(cps, start, end)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for whole in batches:
        lists = pa.types.is_list(whole.column(0).type)
        for batch in [whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)] if lists else tk.slices(whole, "text"):
            counts += np.bincount(bucket(_hashes(batch)), minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["bucket", "n"])


def word_rarity(texts: DataFrame) -> np.ndarray:
    """How common the words of all texts are (column `text`, or lists of members of any kind), by hash bucket: STEPS times
    the binary logarithm of the occurrences in the bucket, an upper bound of each word's own. Every text is counted. On this
    scale no corpus reaches the end of the range, so common words stay apart from each other and from rare ones at any
    size. The result has BUCKETS numbers however many texts there are, so the driver may hold and broadcast it; a task
    hands on at most one row a bucket that it met."""
    counts = texts.select("text").mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.floor(F.log2(F.sum("n") + 1.0) * STEPS).cast("int").alias("n"))
    out = np.zeros(BUCKETS, np.int32)
    for r in counts.toArrow().to_batches():
        out[r.column("bucket").to_numpy()] = r.column("n").to_numpy()
    return out


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """So many rarest words of a set of n words are enough: a set at least `threshold` similar shares one of them."""
    return np.where(n > 0, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)


def enough(na: Column, nb: Column, threshold: float) -> Column:
    """The least number of common words of two sets of these sizes that are `threshold` similar."""
    return F.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)


def set_prefixes(rarity: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (side, id, s) to (side, id, n, prefix): the hashes of the rarest members that the prefix filter needs, the
    rarest first. s must hold no member twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                h, row = member_hashes(batch.column("s"))
                order = np.lexsort((h, rarity[bucket(h)], row))
                h, row = h[order], row[order]
                n = np.bincount(row, minlength=batch.num_rows)
                rank = np.arange(len(h)) - (np.cumsum(n) - n)[row]
                kept = rank < prefix_length(n, threshold)[row]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=batch.num_rows))])
                prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[kept].view(np.int64)))
                yield pa.record_batch([batch.column("side"), batch.column("id"), pa.array(n.astype(np.int32)), prefix], ["side", "id", "n", "prefix"])

    return run
