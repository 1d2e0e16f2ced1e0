"""Evaluation texts inside training documents: a prefix-filtered set join of shingles with exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk
from sievework.operators.key_filter import likely_in, rows_in
from sievework.operators.word_rarity import bucket, word_rarity
from sievework.session import stage


def _windows(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values."""
    m = len(values) - n + 1
    out = np.zeros(max(0, m), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = tk.mix(out * np.uint64(tk.BASE) + values[j : j + m]) if m > 0 else out
    return out


def _prefixes(rarity: np.ndarray, run_length: int, shingle: int, least: int | None = None, every: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text the shingles that the prefix filter needs, with their places and the number of the text's words: of every
    window of run_length words the rarest one; of a shorter text of at least `least` words, its own rarest one; or every one."""
    seen = rarity.astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                cps, offs = tk.codepoints(batch.column("text"))
                start, end, text = tk.words(cps, offs)
                if len(start) < (least or run_length):
                    continue
                h = tk.word_hashes(cps, start, end)
                rare = tk.sliding(seen[bucket(h)].astype(np.uint64), shingle, np.minimum)
                value = _windows(h, shingle)
                n = len(value)
                order = (rare << np.uint64(48)) | (value >> np.uint64(16)) | np.uint64(1)
                inside = text[:n] == text[shingle - 1 :]
                if every:
                    at = np.flatnonzero(inside)
                else:
                    whole_window = np.zeros(n, bool)
                    m = max(0, len(h) - run_length + 1)
                    whole_window[:m] = text[:m] == text[run_length - 1 :]
                    at = tk.minimal(order, run_length - shingle + 1, whole_window)
                    if least:
                        size = np.bincount(text, minlength=batch.num_rows)[text[:n]]
                        of_short = np.flatnonzero(inside & (size >= least) & (size < run_length))
                        by = of_short[np.lexsort((order[of_short], text[of_short]))]
                        at = np.sort(np.concatenate([at, by[np.append(True, text[by][1:] != text[by][:-1])[: len(by)]]]))
                doc, key = text[at], value[at]
                first_word, last_word = np.searchsorted(text, doc), np.searchsorted(text, doc, side="right")
                by = np.lexsort((at, key, doc))
                at, doc, key, first_word, size = at[by], doc[by], key[by], first_word[by], (last_word - first_word)[by]
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                first = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array((at - first_word).astype(np.int32)))
                yield pa.record_batch([pa.array(key[first].view(np.int64)), batch.column("id").take(pa.array(doc[first])), places, pa.array(size[first].astype(np.int32))], ["key", "id", "at", "n"])

    return run


def room(at_d: Column, n_d: Column, at_e: Column, n_e: Column, run_length: int) -> Column:
    """Whether a run of run_length words, or of all words of a shorter text of an item, can pass through an equal shingle at one
    of these places of both texts: as many words must lie around it, within the shorter reach of either text."""
    return F.exists(at_d, lambda i: F.exists(at_e, lambda j: F.least(i, j) + F.least(n_d - i, n_e - j) >= F.least(F.lit(run_length), n_e)))


class Words:
    """The words of a column of texts: code points in lower case, their borders, hashes, and those of all runs of n words."""

    def __init__(self, texts: pa.Array, n: int):
        cps, offs = tk.codepoints(texts)
        self.start, self.end, text = tk.words(cps, offs)
        self.low = tk.lower()[cps]
        self.runs = _windows(tk.word_hashes(cps, self.start, self.end), n)
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))
        self.n = n

    def of(self, i: int) -> np.ndarray:
        """Hashes of the runs of text i, by their first word."""
        return self.runs[self.first[i] : max(self.first[i], self.first[i + 1] - self.n + 1)]

    def words(self, i: int) -> list[bytes]:
        return [self.low[self.start[w] : self.end[w]].tobytes() for w in range(self.first[i], self.first[i + 1])]

    def run(self, i: int, at: int) -> list[bytes]:
        a = self.first[i] + at
        return [self.low[self.start[w] : self.end[w]].tobytes() for w in range(a, a + self.n)]


def holds_run(d: Words, i: int, e: Words, j: int) -> bool:
    """Whether text i of d and text j of e hold a run of words in common. Runs of equal hash are compared letter by letter."""
    a, b = d.of(i), e.of(j)
    if not len(b):  # a text shorter than a run is sought as a whole
        text, own = d.words(i), e.words(j)
        return any(text[k : k + len(own)] == own for k, w in enumerate(text) if w == own[0]) if own else False
    for h in np.intersect1d(a, b):
        of_b = [e.run(j, int(y)) for y in np.flatnonzero(b == h)]
        if any(d.run(i, int(x)) in of_b for x in np.flatnonzero(a == h)):
            return True
    return False


def _verify(run_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text_d"):
                d, e = (Words(batch.column(c), run_length) for c in ("text_d", "text_e"))
                found = [holds_run(d, i, e, i) for i in range(batch.num_rows)]
                yield pa.record_batch([batch.column("id_d"), batch.column("id_e"), pa.array(found, pa.bool_())], ["id_d", "id_e", "found"])

    return run


def leaked(docs: DataFrame, items: DataFrame, fields: list[str], doc_id: str = "doc_id", item_id: str = "id", text: str = "text", run_length: int = 16, shingle: int = 3, least: int | None = None) -> DataFrame:
    """(doc_id, item_id, field): each document whose text holds run_length consecutive words that are also consecutive words
    of a field of an item. With `least` (no fewer than `shingle`), a field with fewer words than run_length, but at least that
    many, counts where a document holds all of them in a row; else such fields are never found.

    Words are runs of letters and digits, compared in lower case, letter by letter. Null and short texts (fewer than
    run_length words) hold nothing; equal texts of items are compared once; rows without an id are left out and
    repeated rows add nothing.
    Empty tables give no rows.

    Plan: one pass over all texts for the fixed-size table of word rarity; a pass that keeps, of every window of run_length
    words, the rarest shingle (containment of a window needs it, on both sides); an equi-join of these, bounded by whether the
    texts' lengths and the shingle's places leave room for a run. Then the texts of candidates alone are fetched, by a bounded
    filter of their ids before the shuffle, and all their windows compared.
    """
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    e = items.select(F.col(item_id).alias("item"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f"))
    e = e.select("item", "f.field", "f.text").where(F.col("text").isNotNull() & F.col("item").isNotNull())
    # equal texts of items count once: their digest stands for them
    e = stage(e.withColumn("id", F.md5("text")), "eval-fields")
    distinct = e.groupBy("id").agg(F.first("text").alias("text"))
    rarity = word_rarity(d.select("text").unionByName(distinct.select("text")))
    if least is not None and least < shingle:
        raise ValueError("least must not be below the size of a shingle")
    run = _prefixes(rarity, run_length, shingle, least)
    kind = d.schema["id"].dataType.simpleString()
    right = distinct.select("id", "text").mapInArrow(run, "key bigint, id string, at array<int>, n int")
    right = stage(right.select("key", F.col("id").alias("id_e"), F.col("at").alias("e"), F.col("n").alias("n_e")), "eval-shingles")
    # shorter fields may stand anywhere, so every shingle of a document counts; those that no field has fall to the filter
    left = d.mapInArrow(run if least is None else _prefixes(rarity, run_length, shingle, least, every=True), f"key bigint, id {kind}, at array<int>, n int").select("key", F.col("id").alias("id_d"), F.col("at").alias("d"), F.col("n").alias("n_d"))
    left = likely_in(left, "key", right.select("key"))
    met = left.join(right, "key").where(room(F.col("d"), F.col("n_d"), F.col("e"), F.col("n_e"), run_length)).select("id_d", "id_e").distinct()
    met = stage(met, "leak-candidates")
    wanted = stage(met.select(F.col("id_d").alias("id")).distinct(), "leak-ids")
    texts = rows_in(d, "id", wanted).dropDuplicates(["id"]).select(F.col("id").alias("id_d"), F.col("text").alias("text_d"))
    pairs = met.join(distinct.select(F.col("id").alias("id_e"), F.col("text").alias("text_e")), "id_e").join(texts, "id_d")
    found = pairs.mapInArrow(_verify(run_length), f"id_d {kind}, id_e string, found boolean").where("found")
    return found.join(e.select(F.col("id").alias("id_e"), "item", "field"), "id_e").select(F.col("id_d").alias("doc_id"), F.col("item").alias("item_id"), "field").distinct()
