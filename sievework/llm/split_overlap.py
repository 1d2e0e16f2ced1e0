"""Records of evaluation splits that stand, exactly or nearly, in the training split too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk
from sievework.functions.text import split_name
from sievework.operators.key_filter import rows_in
from sievework.operators.word_rarity import bucket, enough, prefix_length, word_rarity
from sievework.session import stage

NOT_BLANK = r"[^\p{Z}\s\x85\x1c-\x1f]"
PIECES = "array<struct<start:int,end:int>>"


def _signatures(rarity: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "state"):
                n_rows = batch.num_rows
                cps, offs = tk.codepoints(batch.column("state"))
                start, end, text = tk.words(cps, offs)
                h = tk.word_hashes(cps, start, end)
                place = np.arange(len(h)) - np.searchsorted(text, text)
                with np.errstate(over="ignore"):
                    sums = [tk.by_text(tk.mix(h + (place.astype(np.uint64) + np.uint64(s)) * np.uint64(tk.BASE)), text, n_rows) for s in (11, 1 << 40)]
                order = np.lexsort((h, rarity[bucket(h)], text))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                h, text = h[new], text[new]
                n = np.bincount(text, minlength=n_rows)
                rank = np.arange(len(h)) - (np.cumsum(n) - n)[text]
                q_cps, q_offs = tk.codepoints(batch.column("question"))
                q = tk.Rolling(tk.fold()[q_cps], 5, skip=True).of(q_offs[:-1], q_offs[1:])
                with np.errstate(over="ignore"):
                    keys = tk.mix(h + q[text])
                kept = rank < prefix_length(n, threshold)[text]
                ends = np.concatenate([[0], np.cumsum(np.bincount(text[kept], minlength=n_rows))])
                prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[kept].view(np.int64)))
                yield pa.record_batch(
                    [batch.column("id"), batch.column("train"), *(pa.array(x.view(np.int64)) for x in (q, *sums)), pa.array(n.astype(np.int32)), prefix],
                    ["id", "train", "q", "seq_a", "seq_b", "n", "prefix"],
                )

    return run


class Shard:
    """One automaton over the normalised passages of a shard of evaluation records: every run of `length` of a record's words
    (all of them, if it has fewer), and its single words, each between blanks. scan() tells which of them a text holds."""

    def __init__(self, records: list[list[str]], length: int):
        self.length = length
        number: dict[str, int] = {}

        def of(passage: str) -> int:
            return number.setdefault(passage, len(number))

        self.words = [np.array([of(w) for w in dict.fromkeys(r)], np.int64) for r in records]
        self.passages = [np.array([of(" ".join(r[i : i + length])) for i in range(max(1, len(r) - length + 1))], np.int64) for r in records]
        self.sizes = [len(r) for r in records]
        automaton = ahocorasick.Automaton()
        for passage, i in number.items():
            automaton.add_word(f" {passage} ", i)
        automaton.make_automaton()
        self.automaton, self.n = automaton, len(number)

    def scan(self, words: list[str]) -> np.ndarray:
        hit = np.zeros(self.n, bool)
        hit[[i for _, i in self.automaton.iter(f" {' '.join(words)} ")]] = True
        return hit

    def common(self, record: int, hit: np.ndarray) -> int:
        """How many of the record's distinct words were met."""
        return int(hit[self.words[record]].sum())

    def intervals(self, record: int, hit: np.ndarray) -> list[tuple[int, int]]:
        """The places of the record's words that lie in passages that were met, merged into intervals."""
        starts = np.flatnonzero(hit[self.passages[record]])
        if not len(starts):
            return []
        ends = np.minimum(starts + self.length, self.sizes[record])
        cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(starts) - 1]])
        return list(zip(starts[first].tolist(), ends[last].tolist(), strict=True))


def _scan(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The automaton of a shard of evaluation records scans the training texts that are routed to the shard, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "state_e", 1 << 21):
                ids_e, ids_t = batch.column("id_e").to_pylist(), batch.column("id_t").to_pylist()
                texts_e = dict(zip(ids_e, batch.column("state_e").to_pylist(), strict=True))
                place = {i: k for k, i in enumerate(texts_e)}
                shard = Shard([tk.word_list(s) for s in texts_e.values()], length)
                texts_t = batch.column("state_t")
                jaccard, covered, pieces = np.zeros(len(ids_e)), np.zeros(len(ids_e)), [[]] * len(ids_e)
                pairs_of: dict[object, list[int]] = {}
                for k, t in enumerate(ids_t):
                    pairs_of.setdefault(t, []).append(k)
                for own in pairs_of.values():
                    words = tk.word_list(texts_t[own[0]].as_py())
                    hit, size = shard.scan(words), len(set(words))
                    for k in own:
                        e = place[ids_e[k]]
                        both = shard.common(e, hit)
                        jaccard[k] = both / max(1, len(shard.words[e]) + size - both)
                        pieces[k] = shard.intervals(e, hit)
                        covered[k] = sum(b - a for a, b in pieces[k]) / max(1, shard.sizes[e])
                found = [[{"start": a, "end": b} for a, b in p] for p in pieces]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                sizes = pa.array([shard.sizes[place[i]] for i in ids_e], pa.int32())
                yield pa.record_batch([batch.column("id_e"), batch.column("id_t"), pa.array(jaccard), pa.array(covered), sizes, pa.array(found, kind)], ["ce", "ct", "jaccard", "coverage", "size", "pieces"])

    return run


def split_overlap(
    df: DataFrame, id_col: str, state: str = "state", question: str = "question", split: str = "split", threshold: float = 0.8, passage: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(links, members). Rows of one question and one sequence of words form a class; members is (c, id, train), each row with
    its class, named by its least id. links is (ce, ct, jaccard, coverage, size, pieces): each class with val or test rows and
    each class with train rows (it may be the same one) whose questions agree after folding and whose states' sets of distinct
    words have a Jaccard similarity of at least `threshold`. pieces are the intervals of the evaluation state's words that
    lie in runs of `passage` words (all words of a shorter state) found in the training state, coverage their share of its `size` words.

    Rows with a null id, a null or blank state or a null split, and states without any word, are left out; a null question counts as
    an empty one; repeated rows add nothing. An empty table gives no rows.

    Plan: a pass over all texts for the fixed-size rarity table, and one for signatures: hashes, and the rarest words that a
    set this similar must share. Their equi-join, with bounds on lengths and positions, routes each training text to
    the evaluation records it may overlap. The texts of these alone are shuffled; sorted by evaluation record, each
    stretch of about 2 MB is a shard whose automaton scans the texts routed to it. What it meets decides similarity and coverage.
    """
    s = split_name(F.col(split))
    rows = df.select(F.col(id_col).alias("id"), F.col(state).alias("state"), F.col(question).alias("question"), (s == "train").alias("train"))
    rows = rows.where(s.isin("train", "val", "test") & F.col("id").isNotNull() & F.col("state").isNotNull() & F.col("state").rlike(NOT_BLANK))
    kind = rows.schema["id"].dataType.simpleString()
    rarity = word_rarity(rows.select(F.col("state").alias("text")))
    signed = rows.mapInArrow(_signatures(rarity, threshold), f"id {kind}, train boolean, q bigint, seq_a bigint, seq_b bigint, n int, prefix array<bigint>")
    signed = stage(signed.where("n > 0"), "signatures")
    key = ["q", "seq_a", "seq_b"]
    classes = signed.groupBy(*key).agg(F.min("id").alias("c"), F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("e"), F.min("n").alias("n"), F.min_by("prefix", "id").alias("prefix"))
    classes = stage(classes, "overlap-classes")
    words = classes.select("c", "t", "e", "n", F.posexplode("prefix").alias("at", "key"))
    left = words.where("e").select("key", F.col("c").alias("ce"), F.col("n").alias("ne"), F.col("at").alias("ae"))
    right = words.where("t").select("key", F.col("c").alias("ct"), F.col("n").alias("nt"), F.col("at").alias("at"))
    least = enough(F.col("ne"), F.col("nt"), threshold)
    bounds = (F.col("ce") != F.col("ct")) & (F.col("ne") - F.col("ae") >= least) & (F.col("nt") - F.col("at") >= least)
    near = left.join(right, "key").where(bounds).select("ce", "ct").distinct()
    near = stage(near.unionByName(classes.where("e and t").select(F.col("c").alias("ce"), F.col("c").alias("ct"))), "near")
    wanted = stage(near.select(F.col("ce").alias("id")).union(near.select(F.col("ct").alias("id"))).distinct(), "near-ids")
    texts = stage(rows_in(rows.select("id", "state"), "id", wanted).dropDuplicates(["id"]), "near-texts")
    pairs = near.join(texts.select(F.col("id").alias("ct"), F.col("state").alias("state_t")), "ct").join(texts.select(F.col("id").alias("ce"), F.col("state").alias("state_e")), "ce")
    pairs = pairs.select(F.col("ce").alias("id_e"), F.col("ct").alias("id_t"), "state_e", "state_t")
    found = pairs.mapInArrow(_scan(passage), f"ce {kind}, ct {kind}, jaccard double, coverage double, size int, pieces {PIECES}")
    links = stage(found.where(F.col("jaccard") >= threshold - 1e-12), "overlap-links")
    members = stage(signed.select("id", "train", *key).distinct().join(classes.select(*key, "c"), key).select("c", "id", "train"), "overlap-members")
    return links, members


def overlap_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_e, id_t, jaccard, coverage): every evaluation row with every train row that it overlaps."""
    e = members.where("not train").select(F.col("c").alias("ce"), F.col("id").alias("id_e"))
    t = members.where("train").select(F.col("c").alias("ct"), F.col("id").alias("id_t"))
    return links.select("ce", "ct", "jaccard", "coverage").join(e, "ce").join(t, "ct").select("id_e", "id_t", "jaccard", "coverage")


def _merged(pieces: Column) -> Column:
    """Number of places in the union of intervals, which come sorted."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0), p["end"] - F.greatest(p["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], p["end"]).alias("upto"))
    return F.aggregate(pieces, start, step, lambda a: a["n"])


def overlap_report(df: DataFrame, links: DataFrame, members: DataFrame, id_col: str, split: str = "split", source: str = "source") -> DataFrame:
    """(split, source, n_rows, n_overlapping, n_pairs, mean_coverage) of the evaluation rows: how many there are and have an
    overlapping train row, the number of pairs, and the mean share of an overlapping row's words that lie in passages of any
    of its train rows. Pairs are counted by the sizes of classes, never listed; equal intervals are merged before they are shuffled."""
    sizes = members.where("train").groupBy(F.col("c").alias("ct")).agg(F.count(F.lit(1)).alias("n_t"))
    counts = links.join(sizes, "ct").groupBy("ce").agg(F.sum("n_t").alias("n"), F.max("size").alias("size"))
    pieces = links.select("ce", F.explode("pieces").alias("p")).groupBy("ce", F.col("p.start").alias("start")).agg(F.max("p.end").alias("end"))
    union = pieces.groupBy("ce").agg(_merged(F.array_sort(F.collect_list(F.struct("start", "end")))).alias("covered"))
    of = counts.join(union, "ce", "left").select("ce", "n", (F.coalesce("covered", F.lit(0)) / F.col("size")).alias("share"))
    own = members.where("not train").join(of, members["c"] == of["ce"]).select("id", "n", "share")
    rows = df.select(F.col(id_col).alias("id"), split_name(F.col(split)).alias("split"), F.col(source).alias("source")).where(F.col("split").isin("val", "test"))
    return rows.join(own, "id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.round(F.avg("share"), 6).alias("mean_coverage")
    )
