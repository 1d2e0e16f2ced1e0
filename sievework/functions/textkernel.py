"""Vectorised text kernels for Arrow batches.

A batch's texts are decoded once into one array of code points; words, folded texts, k-mers and their hashes are then
array expressions over it, so no Python code runs per character or per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
WORD = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most max_bytes of the text column (a longer single text makes a slice of its own)."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
    start, base = 0, 0.0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, ends[stop - 1]


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of each text in them); a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    buffers = col.buffers()
    offs = np.frombuffer(buffers[1], np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(buffers[2], np.uint8)[offs[0] : offs[-1]] if buffers[2] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    text = raw.tobytes().decode("utf-8", "replace")
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(raw):
        return cps, offs
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return cps, before[offs]


@lru_cache(None)
def is_word() -> np.ndarray:
    """By code point: is it a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@lru_cache(None)
def lower() -> np.ndarray:
    """By code point: its lower case, where that is one character; else itself."""
    t = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x41, 0x1F000):
        low = chr(i).lower()
        if len(low) == 1:
            t[i] = ord(low)
    return t


@lru_cache(None)
def fold() -> np.ndarray:
    """By code point: its folded form for comparisons, 0 where it is skipped. The lower case of one capital is a letter
    and a combining mark; the mark is skipped as any other."""
    t = np.where(is_word(), lower(), 0).astype(np.uint32)
    for i in range(0x41, 0x1F000):
        low = [c for c in chr(i).lower() if c.isalnum()]
        if is_word()[i] and low:
            t[i] = ord(low[0])
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * (0 if have is None else len(have)))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[base] = have
    return have


@lru_cache(16)
def _codes(seed: int) -> np.ndarray:
    """A random number for each code point."""
    return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(seed * 0x632BE59BD9B4E019 & MASK))


class Rolling:
    """Rolling polynomial hashes modulo 2^64 over an array of code points or bytes: the hash of any stretch is one subtraction and one
    product, and depends on its symbols alone. With skip, symbols that are 0 are passed over as if they were not there, so a
    stretch has the hash of its other symbols, which are never put together."""

    def __init__(self, symbols: np.ndarray, seed: int = 1, base: int = BASE, skip: bool = False):
        self.base = base
        n = len(symbols)
        self.rank = None
        with np.errstate(over="ignore"):
            coded = _codes(seed)[symbols]
            falling = powers(pow(base, -1, 1 << 64), n + 1)
            if skip:
                counts = symbols > 0
                self.rank = np.zeros(n + 1, np.int64)
                np.cumsum(counts, out=self.rank[1:])
                coded *= counts
                coded *= falling[self.rank[:-1]]
            else:
                coded *= falling[:n]
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(coded, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (start, end) if self.rank is None else (self.rank[start], self.rank[end])
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * powers(self.base, len(self.sums))[a] + (b - a).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every stretch of k symbols (without skip)."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:n]) * powers(self.base, len(self.sums))[:n] + np.uint64(k))


def words(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every maximal run of letters and digits; a run never crosses a text's end."""
    inside = np.zeros(len(cps) + 2, bool)
    inside[1:-1] = is_word()[cps]
    turn = inside[1:] != inside[:-1]
    cut = offs[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(cps))])
    both = cut[inside[cut] & inside[cut + 1]]  # a run over the border of two texts: it ends and begins there
    edge = np.flatnonzero(turn)
    if len(both):
        edge = np.sort(np.concatenate([edge, both, both]), kind="stable")
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    return Rolling(lower()[cps], seed).of(start, end)


def sliding(values: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every w consecutive values (minimum or maximum), in time independent of w."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    if w == 1:
        return values.copy()
    pad = -len(values) % w
    v = np.concatenate([values, np.repeat(values[-1:], pad)]).reshape(-1, w)
    ahead = op.accumulate(v, axis=1).ravel()
    back = op.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def minimal(order: np.ndarray, w: int, whole: np.ndarray) -> np.ndarray:
    """Positions whose value is the least of at least one window of w positions; whole tells, for each window's first
    position, whether it lies in one text. Equal stretches of w positions always yield an equal position."""
    n = len(order) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = sliding(order, w, np.minimum)
    least = np.where(whole[:n], least, 0)
    padded = np.zeros(n + 2 * (w - 1), order.dtype)
    padded[w - 1 : w - 1 + n] = least
    best = sliding(padded, w, np.maximum)  # of the windows that hold each position
    return np.flatnonzero((best == order) & (order > 0))


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i]+length[i]-1 of all i, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, length)


def word_list(text: str) -> list[str]:
    """The words of one text, as words() and lower() see them."""
    found = WORD.findall(text)
    low = [w.lower() for w in found]
    if "Σ" in text or "İ" in text:
        table = lower()
        low = ["".join(chr(table[ord(c)]) for c in w) for w in found]
    return low


def by_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of values per text; text must be ascending."""
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values.astype(np.uint64), out=sums[1:])
        at = np.searchsorted(text, np.arange(n + 1))
        return sums[at[1:]] - sums[at[:-1]]
