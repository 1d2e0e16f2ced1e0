"""Exact byte-level BPE of whole tables by dynamic programming over prefixes.

Every prefix of a piece has exactly one possible last token under the merge order. For each prefix, an automaton over the
vocabulary gives the longest token that ends there and, by suffix links, the shorter ones; the one that is compatible with
the last token of the prefix before it is kept. Following these last tokens back gives the ids. All distinct pieces of a
batch advance together, one byte a step, as arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Name of the text column on its way to the encoder; a column of the caller is not called so.
INPUT = "_text_to_encode"
#: A pair of ids as one number; more ids than a vocabulary can have.
PAIR = 1 << 24
# The pieces' pattern splits off these endings after an apostrophe.
ENDINGS = ("s", "d", "m", "t", "ll", "ve", "re")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: visible Latin-1 characters stand for themselves, the others for
    the characters from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict[str, np.ndarray]:
    """The arrays an encoder needs, from a tokenizers JSON file of kind byte-level BPE: bytes of each id, and the pair each
    merged id is made of. About 1 MB for 50,000 ids, so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = byte_alphabet()
    special = {t for t in model["vocab"] if any(c not in alphabet for c in t)}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    size = max(vocab.values()) + 1
    token: list[bytes] = [b""] * size
    for t, i in vocab.items():
        token[i] = bytes(alphabet[c] for c in t)
    left, right, order = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        i = vocab[a + b]
        if order[i] < 0:
            left[i], right[i], order[i] = vocab[a], vocab[b], rank
    merged = order >= 0
    for i in range(size):
        if not merged[i] and len(token[i]) != 1:
            token[i] = b""  # an id that no merge makes (a special token) never comes out
    if np.any(np.diff(order[merged]) < 0):
        raise ValueError("ids are not in the order of merges")
    lengths = np.array([len(t) for t in token], np.int64)
    return {"bytes": np.frombuffer(b"".join(token), np.uint8), "lengths": lengths, "left": left, "right": right}


class Encoder:
    def __init__(self, vocabulary: dict[str, np.ndarray]):
        self.length = vocabulary["lengths"]
        ends = np.cumsum(self.length)
        raw = vocabulary["bytes"].tobytes()
        token = [raw[e - n : e] for e, n in zip(ends, self.length, strict=True)]
        n = len(token)
        base = np.flatnonzero(vocabulary["left"] < 0)
        # an id that is no merge splits into itself, which ends the test below
        self.left, self.right = vocabulary["left"].copy(), vocabulary["right"].copy()
        self.left[base], self.right[base] = base, base
        # ids in the order of merges: bytes come before all merged ids
        self.rank = np.arange(n, dtype=np.int64)
        self.rank[base] = -1
        made = np.flatnonzero(vocabulary["left"] >= 0)
        self._pairs(self.left[made] * PAIR + self.right[made], made)
        self._automaton(token)

    def _pairs(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Open addressing at a load of at most a quarter, so that nearly every look-up ends at its first slot."""
        self.shift = np.uint64(64 - max(10, int(4 * len(keys)).bit_length()))
        self.pair_key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.pair_id = np.full(len(self.pair_key), -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.pair_key[slot] < 0
            self.pair_key[slot[free]] = keys[free]
            placed = self.pair_key[slot] == keys
            self.pair_id[slot[placed]] = ids[placed]
            keys, ids, slot = keys[~placed], ids[~placed], (slot[~placed] + 1) % len(self.pair_key)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(tk.BASE)) >> self.shift).astype(np.int64)

    def merged(self, keys: np.ndarray) -> np.ndarray:
        """The id each pair merges to, -1 where it has no merge."""
        slot = self._slot(keys)
        there = self.pair_key[slot]
        out = np.where(there == keys, self.pair_id[slot], -1)
        more = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[more]
        while len(more):
            slot = (slot + 1) % len(self.pair_key)
            there = self.pair_key[slot]
            hit = there == keys[more]
            out[more[hit]] = self.pair_id[slot[hit]]
            on = ~hit & (there >= 0)
            more, slot = more[on], slot[on]
        return out

    def _automaton(self, token: list[bytes]) -> None:
        """Transitions over the vocabulary, the longest token that ends at each state, and each token's longest proper
        suffix that is a token."""
        node: dict[bytes, int] = {b"": 0}
        for t in token:
            for i in range(1, len(t) + 1):
                node.setdefault(t[:i], len(node))
        by_depth: dict[int, list[bytes]] = {}
        for s in node:
            by_depth.setdefault(len(s), []).append(s)
        go = np.zeros((len(node), 256), np.int32)
        fail = np.zeros(len(node), np.int32)
        self.longest = np.full(len(node), -1, np.int64)
        self.suffix = np.full(len(token), -1, np.int64)
        ids = {t: i for i, t in enumerate(token) if t}
        for depth in range(1, len(by_depth)):
            level = by_depth[depth]
            own = np.array([node[s] for s in level], np.int32)
            parent = np.array([node[s[:-1]] for s in level], np.int32)
            byte = np.array([s[-1] for s in level])
            if depth > 1:
                fail[own] = go[fail[parent], byte]
            go[parent, byte] = own
            # transitions of the parents are complete only with all their children: levels are filled from the fail states
            go_rows = go[fail[own]]
            go[own] = go_rows
            exact = np.array([ids.get(s, -1) for s in level])
            below = self.longest[fail[own]] if depth > 1 else np.full(len(level), -1)
            self.longest[own] = np.where(exact >= 0, exact, below)
            named = exact >= 0
            self.suffix[exact[named]] = below[named]
        self.go = go

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether two tokens can stand next to each other: undoing merges from the latest on, no pair across their border
        may have a merge that comes before the merges still to be undone."""
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), 1 << 40, np.int64)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            made = self.merged(x * PAIR + y)
            bad = (made >= 0) & (made < lim)
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            ended = bad | ((rx < 0) & (ry < 0))
            undo_first = rx > ry  # of the same token twice, the second is the later merge
            limit[live] = np.where(undo_first, x, y + 1)
            a[live] = np.where(undo_first, self.right[x], x)
            b[live] = np.where(undo_first, y, self.left[y])
            live = live[~ended]
        return ok

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of pieces of data, each not empty."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        place = np.cumsum(length) - length
        last = np.zeros(int(length.sum()), np.int64)
        state = np.zeros(len(start), np.int32)
        counts = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 1), side="right")
        for i, n in enumerate(counts):
            state[:n] = self.go[state[:n], data[start[:n] + i]]
            token = self.longest[state[:n]]
            at = place[:n] + i
            last[at] = token
            open_ = np.flatnonzero(self.length[token] <= i)  # the others span the whole prefix
            while len(open_):
                t = last[at[open_]]
                inner = self.length[t] <= i
                before = last[at[open_] - np.where(inner, self.length[t], 0)]
                fits = self.compatible(before, t)
                open_ = open_[~fits]
                last[at[open_]] = self.suffix[last[at[open_]]]
        ids, owner = [], []
        live, end = np.arange(len(start)), length.copy()
        while len(live):
            t = last[place[live] + end[live] - 1]
            ids.append(t)
            owner.append(live)
            end[live] -= self.length[t]
            live = live[end[live] > 0]
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        step = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        flat, owners = np.concatenate(ids), order[np.concatenate(owner)]
        by = np.lexsort((-step, owners))
        return flat[by].astype(np.int32), np.bincount(owners, minlength=len(start))

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text); of a null or empty text 0."""
        cps, offs = tk.codepoints(col)
        start, text = pieces(cps, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        byte_at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        data = np.frombuffer(cps.tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace"), np.uint8)
        start = byte_at[start]
        length = np.diff(np.append(start, byte_at[-1]))
        powers = tk.powers(pow(tk.BASE, -1, 1 << 64), len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(tk.mix(np.arange(1, 257))[data] * powers[: len(data)], out=sums[1:])
            hashes = (sums[start + length] - sums[start]) * tk.powers(tk.BASE, len(sums))[start] + length.astype(np.uint64)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        rep = first[which]
        odd = length != length[rep]
        even = np.flatnonzero(~odd & (rep != np.arange(len(rep))))
        differs = data[tk.gather(start[even], length[even])] != data[tk.gather(start[rep[even]], length[even])]
        odd[np.repeat(even, length[even])[differs]] = True
        if odd.any():  # pieces whose hash is that of another
            own = np.flatnonzero(odd)
            which[own] = len(first) + np.arange(len(own))
            first = np.append(first, own)
        ids, n = self.encode_pieces(data, start[first], length[first])
        at = np.cumsum(n) - n
        of_piece = n[which]
        out = ids[tk.gather(at[which], of_piece)]
        return out, np.bincount(text, weights=of_piece, minlength=len(offs) - 1).astype(np.int64)


@lru_cache(None)
def classes() -> np.ndarray:
    """By code point: letter, number, white space or other."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.int8, 0x110000)
    t[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return t


def pieces(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, text number) of the pieces that are encoded one by one: an ending after an apostrophe; letters, numbers or
    other signs with one blank before them; the rest of white space."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cps]
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    first[n] = True
    before = np.empty(n, np.int8)
    before[0] = -1
    before[1:] = kind[:-1]
    before[first[:n]] = -1
    starts = kind != before
    space, blank = kind == SPACE, cps == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= before == SPACE
    starts &= ~(after_blank & ~space)  # the blank before is part of the piece
    ends = np.zeros(n, bool)  # the last of white space before something else
    ends[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    starts |= ends
    mark = np.flatnonzero((cps == 39) & (before != OTHER) & ~after_blank)
    if len(mark):
        padded = np.append(cps, [0, 0, 0]).astype(np.int64)
        text_end = offs[np.searchsorted(offs, mark, side="right")]
        for ending in ENDINGS:
            k = len(ending)
            fits = mark + 1 + k <= text_end
            for j, c in enumerate(ending):
                fits &= padded[mark + 1 + j] == ord(c)
            hit = mark[fits]
            starts[hit + 1] = False
            follow = hit + 1 + k
            starts[follow[follow < n]] = True
            mark, text_end = mark[~fits], text_end[~fits]
    at = np.flatnonzero(starts)
    return at, np.searchsorted(offs, at, side="right") - 1


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: dict[str, np.ndarray]) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    key = hash(vocabulary["bytes"].tobytes())
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _run(vocabulary: object, lists: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, INPUT, 1 << 22):
                ids, n = encoder(vocabulary.value).encode(batch.column(INPUT))
                if lists:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                else:
                    out = pa.array(n)
                rest = [c for c in batch.schema.names if c != INPUT]
                yield pa.record_batch([*(batch.column(c) for c in rest), out], [*rest, "ids" if lists else "n_tokens"])

    return run


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", lists: bool = True) -> DataFrame:
    """df without its text and with `ids` (the text's token ids, without special tokens), or, unless lists, `n_tokens`.

    Ids are those of the tokenizer's own library; the strings of special tokens are ordinary text. A null or empty text has
    an empty list. One pass without a shuffle; the vocabulary (about 1 MB) is broadcast. A column named ids or n_tokens
    is replaced.
    """
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(tokenizer_path))
    new = "ids" if lists else "n_tokens"
    kept = [f for f in df.schema.fields if f.name not in (text, new)]
    rows = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias(INPUT))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{new} {'array<int>' if lists else 'bigint'}"])
    return rows.mapInArrow(_run(vocabulary, lists), schema)
