"""Long spans that stand verbatim in more than one document, and fuzzy passages around them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk
from sievework.operators.key_filter import rows_in, rows_not_in
from sievework.operators.word_rarity import bucket, word_rarity
from sievework.session import stage

RUN = "array<struct<a:int,b:int,n:int>>"
PASSAGE = "array<struct<a:int,a_end:int,b:int,b_end:int,exact:int,edits:int>>"
#: All pairs of equal seeds are chained if they are at most MANY or PER_PLACE for each place of a seed; a pair of documents
#: with more (periodic text) is compared by all its windows.
MANY, PER_PLACE = 4096, 8
#: The longest word that counts for a k-mer's rarity, and the rarity of a k-mer without any.
LONGEST, COMMON = 16, (1 << 16) - 1


def _rarest_word(cps: np.ndarray, offs: np.ndarray, k: int, seen: np.ndarray) -> np.ndarray:
    """For each k-mer an estimate of how common its rarest word is; it depends on the k-mer's own characters alone, so only
    words that end and begin inside it, and of at most LONGEST letters, count."""
    start, end, text = tk.words(cps, offs)
    value = np.full(len(cps), COMMON, np.int64)
    whole = (start > offs[text]) & (end < offs[text + 1]) & (end - start <= LONGEST)
    start, end = start[whole], end[whole]
    h = tk.word_hashes(cps, start, end)
    value[start - 1] = np.minimum(seen[bucket(h)].astype(np.int64), COMMON - 1)
    return tk.sliding(value, k - LONGEST - 1, np.minimum)[: len(cps) - k + 1]


def _seeds(k: int, span: int, rarity: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    seen = rarity.astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                cps, offs = tk.codepoints(batch.column("text"))
                if len(cps) < span:
                    continue
                value = tk.Rolling(cps, 9).windows(k)
                rare = _rarest_word(cps, offs, k, seen).astype(np.uint64)
                order = (rare << np.uint64(48)) | (value >> np.uint64(16)) | np.uint64(1)
                end = np.repeat(offs[1:], np.diff(offs))
                at = tk.minimal(order, span - k + 1, np.arange(len(cps)) + span <= end)
                doc = np.searchsorted(offs, at, side="right") - 1
                seed = value[at]
                by = np.lexsort((at, seed, doc))
                at, doc, seed = at[by], doc[by], seed[by]
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])
                first = np.flatnonzero(new)
                place = (at - offs[doc]).astype(np.int32)
                lone = np.diff(np.append(first, len(at))) == 1
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(place))
                more = lists.take(pa.array(np.where(lone, None, np.arange(len(first))), pa.int64()))
                yield pa.record_batch([pa.array(seed[first].view(np.int64)), batch.column("id").take(pa.array(doc[first])), pa.array(place[first]), more], ["seed", "id", "at", "more"])

    return run


def chain(anchors: list[tuple[int, int]], k: int, gap: float = 0.05) -> list[list[tuple[int, int]]]:
    """Collinear chains of matched seeds (place in a, place in b): the best predecessor of each anchor, before it in both
    texts, comes from a Fenwick tree of maxima over places in b; a step costs gap per skipped character, and an anchor that
    gains nothing from any predecessor starts a chain."""
    anchors = sorted(set(anchors))
    ranks = sorted({b for _, b in anchors})
    tree: list[tuple[float, int]] = [(-1e300, -1)] * (len(ranks) + 1)
    score, back, waiting = [0.0] * len(anchors), [-1] * len(anchors), deque()

    def settle(i: int) -> None:
        a, b = anchors[i]
        entry = (score[i] + gap * (a + b), i)
        r = bisect_left(ranks, b) + 1
        while r < len(tree):
            tree[r] = max(tree[r], entry)
            r += r & -r

    for i, (a, b) in enumerate(anchors):
        while waiting and anchors[waiting[0]][0] < a:
            settle(waiting.popleft())
        best, r = (-1e300, -1), bisect_left(ranks, b)
        while r:
            best = max(best, tree[r])
            r -= r & -r
        gain = best[0] - gap * (a + b)
        score[i], back[i] = k + max(0.0, gain), best[1] if gain > 0 else -1
        waiting.append(i)
    used, chains = set(), []
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and i not in used:
            used.add(i)
            path.append(anchors[i])
            i = back[i]
        if path:
            chains.append(path[::-1])
    return chains


def _ahead(a: str, i: int, b: str, j: int) -> int:
    """Number of equal characters from a[i] and b[j] on."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 64
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            return n
        else:
            step = max(1, step // 4)
            most = min(most, n + 4 * step + 3) if step > 1 else most
    return n


def _behind(a: str, i: int, b: str, j: int) -> int:
    """Number of equal characters just before a[i] and b[j]; it reads no more than about twice as many."""
    n = 0
    while size := min(max(64, n), i - n, j - n):
        more = _ahead(a[i - n - size : i - n][::-1], 0, b[j - n - size : j - n][::-1], 0)
        n += more
        if more < size:
            break
    return n


def exact_runs(a: str, b: str, anchors: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Maximal equal runs of at least `least` characters through the anchors, as (start in a, start in b, length)."""
    runs, reached = [], {}
    for i, j in sorted(anchors):
        if reached.get(i - j, -1) > i:
            continue
        back = _behind(a, i, b, j)
        n = back + _ahead(a, i, b, j)
        reached[i - j] = i - back + n
        if n >= least:
            runs.append((i - back, j - back, n))
    return runs


def _one_way(a: str, b: str, ha: np.ndarray, hb: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal equal runs that hold every window of a that stands in b, each with one place in b."""
    seen, first = np.unique(hb, return_index=True)
    runs, upto = [], -1
    for i in np.flatnonzero(np.isin(ha, seen)).tolist():
        if i < upto:
            continue
        j = int(first[np.searchsorted(seen, ha[i])])
        if a[i : i + least] != b[j : j + least]:
            j = b.find(a[i : i + least])  # another window has the same hash
            if j < 0:
                continue
        back, n = _behind(a, i, b, j), _ahead(a, i, b, j)
        runs.append((i - back, j - back, back + n))
        upto = i + n - least + 1
    return runs


def _all_runs(a: str, b: str, least: int) -> list[tuple[int, int, int]]:
    """The same by all windows, for pairs with very many equal seeds: maximal runs that hold every stretch of a that stands
    in b and every stretch of b that stands in a, with one place in the other text each."""
    cps, _ = tk.codepoints(pa.array([a, b]))
    h = tk.Rolling(cps, 9).windows(least)
    ha, hb = h[: max(0, len(a) - least + 1)], h[len(a) : len(a) + max(0, len(b) - least + 1)]
    return sorted({*_one_way(a, b, ha, hb, least), *((i, j, n) for j, i, n in _one_way(b, a, hb, ha, least))})


def _nearest(at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted place the nearest of at (ascending)."""
    i = np.clip(np.searchsorted(at, wanted), 1, max(1, len(at) - 1))
    return np.where(np.abs(at[i - 1] - wanted) <= np.abs(at[np.minimum(i, len(at) - 1)] - wanted), at[i - 1], at[np.minimum(i, len(at) - 1)])


def _matches(seeds: list[tuple[list[int], list[int]]], runs: list[tuple[int, int, int]], k: int) -> list[tuple[int, int]]:
    """Matches of k-mers to chain where all pairs of equal seeds are too many, in proportion to their places: every seed's
    places in a and b one by one, the fewer ones over and over; each place with the one in the other text that is nearest
    to where seeds that stand once in both would have it; and the runs, by their k-mers."""
    sure = np.array(sorted((x[0], y[0]) for x, y in seeds if len(x) == len(y) == 1), np.int64).reshape(-1, 2)
    found = [sure]
    for i, j, n in runs:
        at = np.array([*range(0, n - k, k), n - k], np.int64)
        found.append(np.stack([i + at, j + at], 1))
    for x, y in seeds:
        if len(x) == len(y) == 1:
            continue
        x, y = np.unique(x), np.unique(y)
        turn = np.arange(max(len(x), len(y)))
        found.append(np.stack([x[turn % len(x)], y[turn % len(y)]], 1))
        for side, own, other in ((0, x, y), (1, y, x)):
            shift = np.zeros(len(own), np.int64)
            if len(sure):
                by = sure[np.argsort(sure[:, side], kind="stable")]
                last = np.clip(np.searchsorted(by[:, side], own, side="right") - 1, 0, len(by) - 1)
                shift = by[last, 1 - side] - by[last, side]
            near = np.stack([own, _nearest(other, own + shift)], 1)
            found.append(near if side == 0 else near[:, ::-1])
    m = np.concatenate(found)
    # k-mers that overlap on one diagonal lie in one equal stretch, so one of them stands for it
    _, at = np.unique(np.stack([m[:, 0] - m[:, 1], m[:, 0] // (k // 2)], 1), axis=0, return_index=True)
    return [tuple(x) for x in m[at].tolist()]


def edits(x: str, y: str) -> int:
    """Edit distance of two texts, by the bits of whole numbers: a column of the table at a time."""
    if not x or not y:
        return len(x) + len(y)
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, distance = full, 0, len(x)
    for c in y:
        equal = where.get(c, 0)
        carry = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | (full & ~(carry | up)), up & carry
        distance += bool(rise & last) - bool(fall & last)
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        steady = equal | down
        up, down = fall | (full & ~(steady | rise)), rise & steady
    return distance


def align(a: str, b: str, path: list[tuple[int, int]], runs_on: dict[int, list[tuple[int, int, int]]]) -> tuple[dict[str, int] | None, list[tuple[int, int, int]]]:
    """(passage, runs) of a chain: the maximal equal runs that its matches lie in, one after the other, and the passage from
    the first to the last of them, with its equal characters and the edits between a and b where the runs leave gaps. Where two
    runs overlap in a text, the later one counts from the end of the earlier."""
    runs: list[tuple[int, int, int]] = []
    for i, j in path:
        on = runs_on.get(i - j, [])
        at = bisect_right(on, i, key=lambda r: r[0]) - 1
        if at >= 0 and i < on[at][0] + on[at][2] and (not runs or runs[-1] != on[at]):
            runs.append(on[at])
    if not runs:
        return None, []
    i, j, n = runs[0]
    ends, exact, cost = [i, i + n, j, j + n], n, 0
    for i, j, n in runs[1:]:
        over = max(0, ends[1] - i, ends[3] - j)
        if over >= n:
            continue
        gap_a, gap_b = a[ends[1] : i + over], b[ends[3] : j + over]
        cost += edits(gap_a, gap_b)
        exact += n - over
        ends[1], ends[3] = i + n, j + n
    return dict(zip(("a", "a_end", "b", "b_end", "exact", "edits"), [*ends, exact, cost], strict=True)), runs


def compare(a: str, b: str, seeds: list[tuple[list[int], list[int]]], k: int, span: int) -> tuple[list[tuple[int, int, int]], list[dict[str, int]]]:
    """(runs, passages) of two texts with equal seeds (places in a, places in b): seeds are chained, each chain is aligned, and
    what its matches lie in of at least `span` characters are its runs."""
    pairs, places = (sum(f(len(x), len(y)) for x, y in seeds) for f in (lambda x, y: x * y, lambda x, y: x + y))
    if pairs > max(MANY, PER_PLACE * places):
        matches = _matches(seeds, _all_runs(a, b, span), k)
    else:
        matches = [(i, j) for x, y in seeds for i in x for j in y]
    runs_on: dict[int, list[tuple[int, int, int]]] = {}
    for r in sorted(set(exact_runs(a, b, matches, k))):
        runs_on.setdefault(r[0] - r[1], []).append(r)
    aligned = [align(a, b, path, runs_on) for path in chain(matches, k)]
    runs = sorted({r for _, own in aligned for r in own if r[2] >= span})
    return runs, [p for p, _ in aligned if p]


def _align(k: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text_a", 1 << 22):
                out_runs, out_passages = [], []
                for a, b, seeds in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), batch.column("seeds").to_pylist(), strict=True):
                    runs, passages = compare(a, b, [(s["more_a"] or [s["a"]], s["more_b"] or [s["b"]]) for s in seeds], k, span)
                    out_runs.append([{"a": i, "b": j, "n": n} for i, j, n in runs])
                    out_passages.append(passages)
                ints = pa.int32()
                run_type = pa.list_(pa.struct([(x, ints) for x in ("a", "b", "n")]))
                passage_type = pa.list_(pa.struct([(x, ints) for x in ("a", "a_end", "b", "b_end", "exact", "edits")]))
                yield pa.record_batch([batch.column("id_a"), batch.column("id_b"), pa.array(out_runs, run_type), pa.array(out_passages, passage_type)], ["id_a", "id_b", "runs", "passages"])

    return run


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = 200, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes). pairs: (id_a, id_b, runs, passages) of different texts that share a stretch: passages are the aligned
    chains of shared k-mers, from their first to their last equal stretch, with the characters that are equal and the edits
    in the gaps; runs are the maximal equal stretches of at least `span` characters in these chains (start in a, in b,
    length); a pair may have passages only. id_a < id_b are the least
    ids of their texts. A pair whose equal seeds are very many (periodic text) has no list of every two equal places: its runs
    hold each shared stretch of either text with at least one place in the other, and its chains each place of a seed at least once.
    classes: (id, rep), each document and the least id with the very same text.

    Characters are code points, compared as they are. Null texts and texts shorter than span have no spans, nor have rows
    without an id; a row that repeats an id adds nothing. A stretch that only repeats within one document doesn't count. Any k of at most `span` finds all runs of
    `span`; a shorter one finds fuzzier passages. Empty tables give empty results.

    Plan: equal texts fold into classes by a digest before anything is compared. One pass makes the fixed-size table of word
    rarity. Each window of `span` characters yields its k-mer with the rarest word (of equals, the least hash): phrases
    that many documents share serve as seeds only where a whole window has nothing rarer. So documents that share a run share a seed: a sampled index of about 2/(span-k+2) rows a character,
    most of them three numbers. Seeds are joined; the texts of pairs alone are fetched, by a bounded filter of their ids
    before the shuffle; chains and their alignment decide in parallel.
    """
    k = k or span // 3
    if not LONGEST + 2 <= k <= span:
        raise ValueError(f"k must lie between {LONGEST + 2} and span")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where((F.length("text") >= span) & F.col("id").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    digests = stage(rows.select("id", F.unhex(F.md5("text")).alias("digest")).dropDuplicates(["id"]), "digests")
    heads = digests.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "rep")
    classes = stage(digests.join(heads, "digest", "left").select("id", F.coalesce("rep", "id").alias("rep")), "span-classes")
    copies = stage(classes.where("id <> rep").select("id"), "span-copies")
    rarity = word_rarity(rows.select("text"))
    seeds = rows_not_in(stage(rows.mapInArrow(_seeds(k, span, rarity), f"seed bigint, id {kind}, at int, more array<int>"), "seeds"), "id", copies)
    a = seeds.select("seed", F.col("id").alias("id_a"), F.col("at").alias("a"), F.col("more").alias("more_a"))
    b = seeds.select("seed", F.col("id").alias("id_b"), F.col("at").alias("b"), F.col("more").alias("more_b"))
    met = a.join(b, "seed").where("id_a < id_b").groupBy("id_a", "id_b").agg(F.collect_list(F.struct("a", "b", "more_a", "more_b")).alias("seeds"))
    met = stage(met, "seed-pairs")
    wanted = stage(met.select(F.col("id_a").alias("id")).union(met.select(F.col("id_b").alias("id"))).distinct(), "span-ids")
    texts = stage(rows_in(rows, "id", wanted).dropDuplicates(["id"]), "span-texts")
    pairs = met.join(texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    pairs = pairs.join(texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    found = pairs.mapInArrow(_align(k, span), f"id_a {kind}, id_b {kind}, runs {RUN}, passages {PASSAGE}")
    return stage(found, "span-pairs"), classes


def sharing_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two documents that hold a common run, copies of one text included."""
    links = pairs.where(F.size("runs") > 0).select(F.col("id_a").alias("rep"), F.col("id_b").alias("other"))
    doubles = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.col("rep").alias("other"))
    a = classes.select("rep", F.col("id").alias("x"))
    b = classes.select(F.col("rep").alias("other"), F.col("id").alias("y"))
    both = links.unionByName(doubles).join(a, "rep").join(b, "other")
    both = both.where((F.col("rep") != F.col("other")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _covered(pieces: list[tuple[int, int]]) -> int:
    total, upto = 0, 0
    for a, b in sorted(pieces):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def _sum_cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("rep"), pa.array([_covered([(x["a"], x["b"]) for x in p]) for p in batch.column("p").to_pylist()], pa.int64())], ["rep", "n"])


def shared_share(docs: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, shared_chars, share): how many characters of each document lie in a run that another document holds.
    Null texts have 0 of 0, the share null; a document with a copy is shared whole if it is long enough for a run."""
    kind = classes.schema["id"].dataType.simpleString()
    r = pairs.select("id_a", "id_b", F.explode("runs").alias("r"))
    pieces = r.select(F.col("id_a").alias("rep"), F.col("r.a").alias("a"), F.col("r.n").alias("n")).union(r.select(F.col("id_b"), F.col("r.b"), F.col("r.n")))
    # of pieces with one start the longest is enough, so a document's list is no longer than its text
    pieces = pieces.groupBy("rep", "a").agg(F.max("n").alias("n"))
    pieces = pieces.groupBy("rep").agg(F.collect_list(F.struct("a", (F.col("a") + F.col("n")).alias("b"))).alias("p"))
    cover = pieces.mapInArrow(_sum_cover, f"rep {kind}, n bigint")
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    of = classes.join(sizes, "rep").join(cover, "rep", "left").select("id", "copies", "n")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0)))
    out = rows.join(of, "id", "left").withColumn("shared_chars", shared.cast("bigint"))
    return out.select("id", "n_chars", "shared_chars", F.round(F.try_divide("shared_chars", "n_chars"), 6).alias("share"))
