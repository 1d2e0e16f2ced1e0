"""Languages of texts and of their sentences by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, permuted by their place; a
language's prototype is the weighted sum (bundle) of the trigrams of its labelled texts. A text is
the bundle of its own trigrams and goes to the prototype with the greatest cosine. As that product is linear in the
trigrams, each trigram's products with the prototypes are computed once, and texts only add them up.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk

LANGUAGES = ("en", "de", "fr", "es", "ru", "tr", "fa", "ar")
#: The script group (see letters) of each language, and the fewest letters of a sentence that its script alone gives away.
SCRIPT, SHORT = np.array([1, 1, 1, 1, 2, 1, 3, 3]), 5
BOUNDARY, FOREIGN = 0, 1
#: A part of a stretch must lead by so much more than a whole sentence.
PART_MARGIN = 0.01
#: Sentence ends: a line break, or one of these (a stroke between sentences too) before white space or a closing quotation mark.
ENDS = np.array([ord(c) for c in ".!?؟…/|"], np.uint32)
NOT_BLANK = r"[^\p{Z}\s\x85\x1c-\x1f]"


@lru_cache(None)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: (the letter counted, 0 for a boundary, and 0xFFFFFFFF for signs that are passed over; its script group:
    1 Latin and others, 2 Cyrillic, 3 Arabic). The Arabic and Persian forms of yeh and kaf count as one."""
    low, group = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.int8)
    for i in range(0x41, 0x1F000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            first = next((x for x in c.lower() if x.isalpha()), c)
            low[i] = ord(first)
            group[i] = 2 if 0x400 <= i < 0x530 else 3 if 0x600 <= i < 0x780 else 1
        elif kind in ("Mn", "Cf"):
            low[i] = 0xFFFFFFFF
    low[[0xAD, 0xFEFF]] = 0xFFFFFFFF
    for a, b in ((0x64A, 0x6CC), (0x649, 0x6CC), (0x643, 0x6A9)):  # Arabic form, Persian form
        low[a] = b
    return low, group


def segments(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The first place of each sentence, the texts' first places among them."""
    n = len(cps)
    ender = cps == 10
    if n > 1:
        nxt = cps[1:]
        ender[:-1] |= np.isin(cps[:-1], ENDS) & np.isin(nxt, [32, 10, 13, 9, 34, 0x201D])
    starts = np.zeros(n + 1, bool)
    starts[1:] = ender
    starts[offs[:-1]] = True
    return np.flatnonzero(starts[:n])


class Model:
    """Prototypes over the trigrams of a bounded labelled sample."""

    def __init__(self, dimension: int = 8192, seed: int = 1, per_group: int = 60, smoothing: float = 10.0):
        self.dimension, self.seed, self.per_group, self.smoothing = dimension, seed, per_group, smoothing
        self.letter = None

    def _codes(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trigram number, place of its middle letter) of every letter."""
        low, group = letters()
        c = low[cps]
        kept = np.flatnonzero(c != 0xFFFFFFFF)
        c, g = c[kept], group[cps[kept]]
        first = np.zeros(len(kept) + 1, bool)
        first[np.searchsorted(kept, offs[:-1])] = True
        codes, places = [], []
        for k in (1, 2, 3):
            mid = np.flatnonzero(g == k)
            if not len(mid):
                continue
            number = np.zeros(len(c) + 2, np.int32)
            number[1:-1] = self.numbers[k][c]
            prev = np.where(first[mid], BOUNDARY, number[mid])
            nxt = np.where(first[mid + 1], BOUNDARY, number[mid + 2])
            a = self.per_group + 2
            codes.append(((k - 1) * a + prev) * a * a + number[mid + 1] * a + nxt)
            places.append(mid)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.concatenate(places)
        if len(places) == 1:
            return codes[0], kept[place]
        order = np.argsort(place, kind="stable")
        return np.concatenate(codes)[order], kept[place[order]]

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of trigrams: the letters' vectors, rotated by two, one and no places, multiplied."""
        a = self.per_group + 2
        k, rest = np.divmod(codes, a**3)
        if self.letter is None:
            # a letter's vector depends on the letter alone, not on its rank in the sample
            draw = lambda k, c: np.random.default_rng([self.seed, k, c]).integers(0, 2, self.dimension, np.int8) * 2 - 1
            marks = [[BOUNDARY, FOREIGN, *map(int, own), *range(0x110000, 0x110000 + self.per_group - len(own))] for own in self.alphabets]
            self.letter = np.stack([draw(k, c) for k, own in enumerate(marks) for c in own])
            self.turned = [np.roll(self.letter, n, 1) for n in (2, 1, 0)]
        places = (rest // (a * a), rest // a % a, rest % a)
        x, y, z = (t[k * a + i] for t, i in zip(self.turned, places, strict=True))
        return x * y * z

    def _prototypes(self, counts: np.ndarray) -> np.ndarray:
        """Products of each known trigram with each language's prototype. A trigram is bundled with the logarithm of its rate
        in the language over its mean rate: what all languages share (names, borrowed words) cancels out."""
        present = counts.sum(0) > 0
        rates = counts / np.maximum(1, counts.sum(0)) * 1e6
        mean = rates.sum(1, keepdims=True) / max(1, present.sum())
        weights = np.log((rates + self.smoothing) / (mean + self.smoothing)).astype(np.float32)
        bundle = np.zeros((self.dimension, len(LANGUAGES)), np.float32)
        parts = range(0, len(self.known), 512)
        for i in parts:
            bundle += self._vectors(self.known[i : i + 512]).astype(np.float32).T @ weights[i : i + 512]
        norm = np.linalg.norm(bundle, axis=0)
        bundle = np.divide(bundle, norm, out=np.zeros_like(bundle), where=norm > 0)
        out = np.concatenate([self._vectors(self.known[i : i + 512]).astype(np.float32) @ bundle for i in parts]) / np.sqrt(self.dimension)
        out[:, ~present] = -1
        return out.astype(np.float32)

    def fit(self, texts: pa.Array, labels: np.ndarray, rounds: int = 2) -> Model:
        """labels are numbers into LANGUAGES. After each round, texts that the prototypes place elsewhere are left out."""
        texts = normal(texts)
        cps, offs = tk.codepoints(texts)
        low, group = letters()
        self.numbers, self.alphabets = [np.zeros(0)] * 4, []
        for k in (1, 2, 3):
            number = np.zeros(0x110000, np.uint8)
            number[low[(group > 0) & (group != k)]] = FOREIGN
            number[low[group == k]] = FOREIGN
            seen, n = np.unique(low[cps[group[cps] == k]], return_counts=True)
            top = seen[np.lexsort((seen, -n))][: self.per_group]
            number[top] = 2 + np.arange(len(top))
            self.alphabets.append(top)
            number[0] = BOUNDARY
            self.numbers[k] = number
        codes, place = self._codes(cps, offs)
        text = np.searchsorted(offs, place, side="right") - 1
        self.known, at = np.unique(codes, return_inverse=True)
        kept = np.ones(len(texts), bool)
        for _ in range(rounds):
            counts = np.zeros((len(self.known), len(LANGUAGES)))
            for i in range(len(LANGUAGES)):
                counts[:, i] = np.bincount(at[kept[text] & (labels[text] == i)], minlength=len(self.known))
            self.products = self._prototypes(counts)
            total = np.stack([np.bincount(text, weights=p[at], minlength=len(texts)) for p in self.products.T], 1)
            kept = total.argmax(1) == labels
        a = self.per_group + 2
        self.row = np.full(3 * a**3, len(self.known), np.int32)
        self.row[self.known] = np.arange(len(self.known))
        self.letter = self.turned = None
        # a trigram that no prototype holds has an expected product of 0
        self.products = np.vstack([self.products, np.zeros((1, len(LANGUAGES)), np.float32)])
        return self

    def score(self, cps: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosines with the prototypes, number of letters) of the stretches that begin at starts. The norm of a bundle of n
        trigrams is taken as that of n random vectors."""
        codes, place = self._codes(cps, offs)
        return self.stretches(codes, np.searchsorted(place, np.append(starts, len(cps))))

    def stretches(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of trigrams at[i] to at[i + 1]."""
        n = np.diff(at)
        sums = np.zeros((len(n), len(LANGUAGES)), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            sums[some] = np.add.reduceat(self.products[self.row[codes]], at[some], axis=0)
        return sums / np.sqrt(np.maximum(1, n))[:, None], n


def normal(texts: pa.Array) -> pa.Array:
    """Compatibility forms to ordinary ones, letters and their marks to one letter."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def strings_of(state: str) -> list[str]:
    """The texts of a state: the string values of a JSON document, at any depth; any other text as a whole."""
    if state.lstrip()[:1] in ("{", "["):
        try:
            todo, out = [json.loads(state)], []
            while todo:
                x = todo.pop()
                if isinstance(x, str):
                    out.append(x)
                elif isinstance(x, dict):
                    todo += list(x.values())[::-1]
                elif isinstance(x, list):
                    todo += x[::-1]
            return out
        except (ValueError, RecursionError):
            pass
    return [state]


def _flat(lists: list[list[str] | None]) -> tuple[pa.Array, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists])
    return normal(pa.array([s for x in lists for s in x or ()], pa.string())), rows


def confidence(cosines: np.ndarray, sharpness: float = 12.0) -> np.ndarray:
    """Softmax of the cosines."""
    e = np.exp(sharpness * (cosines - cosines.max(axis=-1, keepdims=True)))
    return e / e.sum(axis=-1, keepdims=True)


def _pieces(ids: list, cps: np.ndarray, offs: np.ndarray, starts: np.ndarray, row: np.ndarray, cosines: np.ndarray, n: np.ndarray, found: dict[int, dict[int, list]], min_letters: int) -> list[tuple]:
    """(id, text, segment, lang, confidence, letters, content) of the rows with several languages: each stretch has the row's
    language whose prototype is nearest; a short one that is not written in a script of one of them alone goes with the
    stretch before it (the first with the next); neighbours of one language in one text are a segment."""
    text = np.searchsorted(offs, starts, side="right") - 1
    group = letters()[1][cps]
    high = np.maximum.reduceat(group, starts)
    low = np.minimum.reduceat(np.where(group == 0, 9, group), starts)
    ends = np.append(starts[1:], len(cps))
    out = []
    for i, langs in found.items():
        if len(langs) < 2:
            continue
        own, mine = np.array(sorted(langs)), np.flatnonzero(row == i)
        pick = own[cosines[mine][:, own].argmax(1)]
        sure = n[mine] >= min_letters
        for k in np.flatnonzero(~sure & (high[mine] == low[mine])):
            fit = own[SCRIPT[own] == high[mine[k]]]
            if len(fit) and len(fit) < len(own):
                pick[k], sure[k] = fit[cosines[mine[k]][fit].argmax()], True
        known = np.flatnonzero(sure)
        if len(known):
            pick = pick[known[np.maximum(0, np.searchsorted(known, np.arange(len(mine)), side="right") - 1)]]
        new = np.append(True, (pick[1:] != pick[:-1]) | (text[mine][1:] != text[mine][:-1]))
        for number, (a, b) in enumerate(zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(mine)), strict=True)):
            part = mine[a:b]
            size = int(n[part].sum())
            if not size:
                continue
            joined = (cosines[part] * np.sqrt(np.maximum(1, n[part]))[:, None]).sum(0) / np.sqrt(size)
            content = "".join(map(chr, cps[starts[part[0]] : ends[part[-1]]])).strip()
            first = int(np.searchsorted(text[mine], text[part[0]]))
            out.append((ids[i], int(text[part[0]] - text[mine[0]]), number - int(new[:first].sum()), LANGUAGES[pick[a]], float(confidence(joined)[pick[a]]), size, content))
    return out


def _detect(states: Model, choices: Model, min_letters: int, margin: float, part: int = 32) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = np.array(LANGUAGES)

    def field(ids: list, lists: list[list[str] | None], model: Model, name: str, mixed: bool, pieces: list | None = None) -> Iterator[tuple]:
        texts, rows = _flat(lists)
        cps, offs = tk.codepoints(texts)
        if not len(cps):
            return
        starts = segments(cps, offs) if mixed else offs[:-1][np.diff(offs) > 0]
        row = rows[np.searchsorted(offs, starts, side="right") - 1]
        codes, place = model._codes(cps, offs)
        at = np.searchsorted(place, np.append(starts, len(cps)))
        cosines, n = model.stretches(codes, at)
        weighed = cosines * np.sqrt(np.maximum(1, n))[:, None]
        sums = np.stack([np.bincount(row, weights=x, minlength=len(lists)) for x in weighed.T], 1)
        letters_of = np.bincount(row, weights=n, minlength=len(lists))
        whole = sums / np.sqrt(np.maximum(1, letters_of))[:, None]
        best = whole.argmax(1)
        own = cosines.argmax(1)
        lead = cosines[np.arange(len(n)), own] - cosines[np.arange(len(n)), best[row]]
        other = (own != best[row]) & (n >= min_letters) & (lead > margin)
        if mixed:
            # sentences that follow each other without any mark: long stretches are looked at in parts as well
            long = np.flatnonzero(n >= 2 * part)
            parts = n[long] // part
            cut = np.repeat(at[long], parts) + (tk.gather(np.zeros(len(long), np.int64), parts) * np.repeat(n[long] / np.maximum(1, parts), parts)).astype(np.int64)
            # the last part of a stretch ends where the stretch does
            ends = np.append(cut[1:], len(codes))
            last = np.cumsum(parts) - 1
            ends[last] = at[long + 1]
            edges = np.stack([cut, ends], 1).ravel()
            c2, n2 = (x[::2] for x in model.stretches(codes, edges)) if len(cut) else (cosines[:0], n[:0])
            r2 = np.repeat(row[long], parts)
            o2 = c2.argmax(1) if len(c2) else own[:0]
            l2 = c2[np.arange(len(n2)), o2] - c2[np.arange(len(n2)), best[r2]]
            keep = (o2 != best[r2]) & (n2 >= min_letters) & (l2 > margin + PART_MARGIN)
            cosines, n = np.concatenate([cosines, c2[keep]]), np.concatenate([n, n2[keep]])
            row, other = np.concatenate([row, r2[keep]]), np.concatenate([other, np.ones(keep.sum(), bool)])
            floor = np.where(np.arange(len(n)) < len(own), margin, margin + PART_MARGIN)
        sure = confidence(whole)
        found: dict[int, dict[int, list]] = {}
        for i in np.flatnonzero(letters_of > 0):
            found[int(i)] = {int(best[i]): [float(sure[i, best[i]]), int(letters_of[i])]}
        if mixed:
            at_other = np.flatnonzero(other)
            at_other = at_other[np.argsort(row[at_other], kind="stable")]
            for group in np.split(at_other, np.flatnonzero(np.diff(row[at_other])) + 1) if len(at_other) else ():
                i = int(row[group[0]])
                # one language at a time, the one with the most to say for it; a stretch counts for a new language only if it
                # leads over all that are known by then, so that names between them make no third
                known = [int(best[i])]
                while True:
                    led = cosines[group] - cosines[group][:, known].max(1, keepdims=True)
                    leader = led.argmax(1)
                    lead = led[np.arange(len(group)), leader]
                    new = lead > floor[group]
                    if not new.any():
                        break
                    lang = int(np.bincount(leader[new], weights=(lead * n[group])[new]).argmax())
                    known.append(lang)
                    mine = group[new & (leader == lang)]
                    found[i][lang] = [float(confidence(cosines[mine])[:, lang].max()), int(n[mine].sum())]
            # shorter sentences in a script that none of the row's languages is written in
            short: dict[tuple[int, int], list[int]] = {}
            group = letters()[1][cps]
            high = np.maximum.reduceat(group, starts)
            low = np.minimum.reduceat(np.where(group == 0, 9, group), starts)
            n = n[: len(own)]
            for k in np.flatnonzero((n >= SHORT) & (n < min_letters) & (high == low) & (high != SCRIPT[best[row[: len(own)]]])):
                i, script = int(row[k]), int(high[k])
                stretch = "".join(map(chr, cps[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(cps)])).rstrip(" \r\n\t\"'”)»")
                if script not in SCRIPT[list(found[i])] and stretch and stretch[-1] in ".!?؟…" and sum(w[0].isalpha() for w in tk.WORD.findall(stretch)) > 1:
                    short.setdefault((i, script), []).append(k)
            for (i, script), mine in short.items():
                lang = int(np.where(SCRIPT == script, weighed[mine].sum(0), -np.inf).argmax())
                found[i][lang] = [float(confidence(cosines[mine])[:, lang].max()), int(n[mine].sum())]
        for i, langs in found.items():
            for lang, (p, size) in langs.items():
                yield ids[i], name, str(names[lang]), p, size, len(langs)
        if pieces is not None:
            pieces += _pieces(ids, cps, offs, starts, row[: len(own)], cosines[: len(own)], n[: len(own)], found, min_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "state"):
                ids = batch.column("id").to_pylist()
                out = []
                lists = [strings_of(s) if s is not None and s.strip() else None for s in batch.column("state").to_pylist()]
                out += field(ids, lists, states, "state", True)
                options = [[" | ".join(x for x in c if x is not None)] if c else None for c in batch.column("choices").to_pylist()]
                out += field(ids, options, choices, "choices", False)
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [batch.schema.field("id").type, pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "field_name", "lang", "confidence", "letters", "n_langs"])

    run.field = field
    return run


def _segments(states: Model, choices: Model, min_letters: int, margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    detect = _detect(states, choices, min_letters, margin).field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "state"):
                found: list[tuple] = []
                lists = [strings_of(s) if s is not None and s.strip() else None for s in batch.column("state").to_pylist()]
                for _ in detect(batch.column("id").to_pylist(), lists, states, "state", True, found):
                    pass
                cols = list(zip(*found, strict=True)) if found else [[]] * 7
                kinds = [batch.schema.field("id").type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "text", "segment", "lang", "confidence", "letters", "content"])

    return run


def label_code(label: Column) -> Column:
    """The language a label means: its part before any - or _, in lower case."""
    return F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^([^-_]*)", 1))


#: Longer texts are not drawn for fitting, so that what the driver reads is bounded in size too; they are labelled as all others.
LONGEST_SAMPLE = 20_000


def _sample(df: DataFrame, text: Column, label: Column, id_col: str, per_language: int, seed: int) -> tuple[pa.Array, np.ndarray]:
    """At most about per_language labelled texts of each language, drawn by a hash of the id over the whole table, of at most
    LONGEST_SAMPLE characters."""
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), label_code(label).alias("lang")).where(F.col("lang").isin(*LANGUAGES) & (F.length("text") <= LONGEST_SAMPLE))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") / F.lit(float(1 << 53))
    got = rows.where(u < F.element_at(rate, F.col("lang"))).select("id", "text", "lang").toArrow().combine_chunks().sort_by("id")
    labels = np.array([LANGUAGES.index(x) for x in got.column("lang").to_pylist()], np.int64)
    return got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()), labels


def _with_lacking(own: tuple[pa.Array, np.ndarray], other: tuple[pa.Array, np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """A field's labelled texts, and the other field's of the languages that it has none of."""
    lacking = ~np.isin(other[1], own[1])
    if not lacking.any():
        return own
    return pa.concat_arrays([own[0].cast(pa.string()), other[0].cast(pa.string()).filter(pa.array(lacking))]), np.concatenate([own[1], other[1][lacking]])


def detect_languages(df: DataFrame, id_col: str, state: str = "state", choices: str = "choices", state_label: str = "state_lang", choice_label: str = "choice_lang", per_language: int = 1000, min_letters: int = 15, margin: float = 0.05, seed: int = 0) -> DataFrame:
    """(id, field_name, lang, confidence, letters, n_langs, fits): for each row the language of its options, and of its state
    each language that has at least one whole sentence, with the letters seen as its own (for the main language, all of the
    state); n_langs tells how many there are.
    fits: the label of the field names that language.

    Of a JSON state the string values count, not its keys. A sentence is in another language than the state's main one if it
    has min_letters letters and its cosine with that language's prototype is greater by `margin`; phrases,
    names and codes are not. A shorter one counts only if it is written in a script of none of the state's other languages,
    ends in a sentence mark and has two words and SHORT letters. Stretches without a sentence mark are looked at in parts of 32 letters as well. Null and blank texts, empty lists and texts without a letter give no row; the order of equal
    cosines is that of LANGUAGES. Prototypes are fitted on about per_language rows of each language, drawn over the whole
    table (the bound on what the driver reads); all rows are then labelled in one pass without a shuffle. A language
    that no label of one field names is fitted on the other field's texts. Without any usable label in either, nothing can be
    fitted and no row comes out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, field_name string, lang string, confidence double, letters int, n_langs int"
    models = fit_models(df, id_col, state, choices, state_label, choice_label, per_language, seed)
    if models is None:
        return df.sparkSession.createDataFrame([], f"{schema}, fits boolean")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _detect(*shared.value, min_letters, margin)(batches)

    rows = df.select(F.col(id_col).alias("id"), F.col(state).alias("state"), F.col(choices).alias("choices"), F.col(state_label).alias("sl"), F.col(choice_label).alias("cl"))
    # labels travel in the id, so that they need no join back
    packed = rows.select(F.struct("id", label_code(F.col("sl")).alias("sl"), label_code(F.col("cl")).alias("cl")).alias("id"), "state", "choices")
    packed_kind = packed.schema["id"].dataType.simpleString()
    out = packed.mapInArrow(run, schema.replace(f"id {kind},", f"id {packed_kind},", 1))
    label = F.when(F.col("field_name") == "state", F.col("id.sl")).otherwise(F.col("id.cl"))
    return out.select(F.col("id.id").alias("id"), "field_name", "lang", "confidence", "letters", "n_langs", (label == F.col("lang")).alias("fits"))


def fit_models(df: DataFrame, id_col: str, state: str, choices: str, state_label: str, choice_label: str, per_language: int, seed: int) -> list[Model] | None:
    """The models of states and of options, each fitted on about per_language labelled rows of a language; None without any label."""
    joined = F.concat_ws(" | ", F.col(choices))
    parts = [_sample(df, F.col(state), F.col(state_label), id_col, per_language, seed), _sample(df, joined, F.col(choice_label), id_col, per_language, seed)]
    if not any(len(t) for t, _ in parts):
        return None
    states, options = parts
    texts, of = _flat([strings_of(s) for s in states[0].to_pylist()]) if len(states[0]) else states
    states = (texts, states[1][of] if len(of) else of)
    return [Model(4096, seed=seed).fit(*_with_lacking(states, options)), Model(32768, seed=seed).fit(*_with_lacking(options, states))]


def segment_languages(df: DataFrame, id_col: str, state: str = "state", choices: str = "choices", state_label: str = "state_lang", choice_label: str = "choice_lang", per_language: int = 1000, min_letters: int = 15, margin: float = 0.05, seed: int = 0) -> DataFrame:
    """(id, text, segment, lang, confidence, letters, content): the segments of each state that holds several languages (see
    detect_languages, which decides which these are), in their order within each of the state's texts (of a JSON state its
    string values); content is in compatibility form, as the prototypes see it. States of one language and those without any
    have no row; nulls and empty tables give none. One pass without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text int, segment int, lang string, confidence double, letters int, content string"
    models = fit_models(df, id_col, state, choices, state_label, choice_label, per_language, seed)
    if models is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _segments(*shared.value, min_letters, margin)(batches)

    return df.select(F.col(id_col).alias("id"), F.col(state).alias("state")).mapInArrow(run, schema)
