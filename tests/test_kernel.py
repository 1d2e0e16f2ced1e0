import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.functions import textkernel as tk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB çİ1_-٣é\n😀Σ", max_size=20)), max_size=6)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_codepoints_and_words(texts):
    cps, offs = tk.codepoints(pa.array(texts, pa.string()))
    assert ["".join(map(chr, cps[a:b])) for a, b in zip(offs[:-1], offs[1:])] == [t or "" for t in texts]
    start, end, of = tk.words(cps, offs)
    found = [[] for _ in texts]
    for a, b, i in zip(start, end, of):
        found[i].append("".join(chr(tk.lower()[c]) for c in cps[a:b]))
    assert found == [tk.word_list(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 9))
def test_minimal_positions(values, w):
    """The positions kept are those that are least in some whole window."""
    v = np.array(values, np.uint64) + np.uint64(1)
    want = sorted({j for i in range(len(v) - w + 1) for j in range(i, i + w) if v[j] == v[i : i + w].min()})
    whole = np.ones(len(v), bool)
    assert tk.minimal(v, w, whole).tolist() == want


def test_rolling_hash_depends_on_content_alone():
    rng = random.Random(1)
    s = [rng.randrange(97, 123) for _ in range(300)]
    a, b = np.array(s + [5] + s, np.uint32), np.array([7, 7] + s, np.uint32)
    ha, hb = tk.Rolling(a), tk.Rolling(b)
    i = np.array([0, 10]), np.array([300, 40])
    assert (ha.of(*i) == hb.of(i[0] + 2, i[1] + 2)).all() and (ha.of(*i) == ha.of(i[0] + 301, i[1] + 301)).all()
    assert (ha.windows(50)[:10] == ha.of(np.arange(10), np.arange(10) + 50)).all()


def test_slices_cover_batches():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 0, 3_000_000, 7)] + [None])], ["text"])
    parts = list(tk.slices(batch, "text", 1 << 20))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) >= 2
    assert list(tk.slices(batch.slice(0, 0), "text")) == []


def test_skipped_symbols_leave_no_trace():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 4, 500).astype(np.uint32)
    h = tk.Rolling(symbols, skip=True)
    a, b = np.sort(rng.integers(0, 501, (2, 200)), axis=0)
    whole = [tk.Rolling(symbols[i:j][symbols[i:j] > 0]).of(np.array([0]), np.array([int((symbols[i:j] > 0).sum())]))[0] for i, j in zip(a, b, strict=True)]
    assert (h.of(a, b) == np.array(whole)).all()
