"""Text that looks right but is spelled with other characters: finding it, and bringing it to one form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk
from sievework.llm import langid
from sievework.operators.key_filter import likely_in
from sievework.session import stage

# Letters of other scripts that look like Latin ones, and the Latin letters, in the same order.
CYRILLIC_FORMS = "АВЕЅІЈКМНОРСТХУЬаеорсухіјѕһԁԛԝ"
CYRILLIC_LATIN = "ABESIJKMHOPCTXYbaeopcyxijshdqw"
GREEK_FORMS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειηκνορτυχγϲ"
GREEK_LATIN = "ABEZHIKMNOPTYXaeinkvoptuxyc"
ARMENIAN_FORMS = "ԼՍՏՕզհոսցօ"
ARMENIAN_LATIN = "LUSOqhnugo"
CHEROKEE_FORMS = "ᎠᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏙᏢᏦᏞᏟᏴ"
CHEROKEE_LATIN = "DTAJEWMHGZRVPKLCB"
LATIN_OF = dict(zip(CYRILLIC_FORMS + GREEK_FORMS + ARMENIAN_FORMS + CHEROKEE_FORMS, CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN + CHEROKEE_LATIN, strict=True))
CYRILLIC_OF = dict(zip(CYRILLIC_LATIN, CYRILLIC_FORMS, strict=True)) | {"k": "к", "t": "т", "m": "м", "n": "п", "r": "г", "u": "и", "v": "ѵ", "B": "В"}
GREEK_OF = dict(zip(GREEK_LATIN, GREEK_FORMS, strict=True))
LATIN, GREEK, CYRILLIC, ARABIC = 1, 2, 3, 4
BLOCKS = ((0x41, 0x250, LATIN), (0x1E00, 0x1F00, LATIN), (0x2C60, 0x2C80, LATIN), (0xA720, 0xA800, LATIN), (0xFB00, 0xFB07, LATIN), (0xFF21, 0xFF5B, LATIN),
          (0x370, 0x400, GREEK), (0x1F00, 0x2000, GREEK), (0x400, 0x530, CYRILLIC), (0x1C80, 0x1C90, CYRILLIC), (0x2DE0, 0x2E00, CYRILLIC), (0xA640, 0xA6A0, CYRILLIC),
          (0x600, 0x700, ARABIC), (0x750, 0x780, ARABIC), (0x8A0, 0x900, ARABIC), (0xFB50, 0xFE00, ARABIC), (0xFE70, 0xFF00, ARABIC),
          (0x530, 0x590, 5), (0x590, 0x600, 6), (0x900, 0xE00, 7), (0xE00, 0xE80, 8), (0x10A0, 0x1100, 9), (0x1100, 0x1200, 10), (0xAC00, 0xD7B0, 10), (0x2E80, 0xA000, 11), (0x13A0, 0x1400, 12), (0xAB70, 0xABC0, 12))
YEH, KAF = {"ar": "ي", "fa": "ی"}, {"ar": "ك", "fa": "ک"}
COMPATIBLE, MARK, INVISIBLE, BLANK, FOREIGN, PERSIAN_ARABIC = 1, 2, 4, 8, 16, 32
KINDS = {"compatibility": COMPATIBLE, "mark": MARK, "invisible": INVISIBLE, "blank": BLANK, "mixed_script": FOREIGN, "yeh_kaf": PERSIAN_ARABIC}
#: Variation selectors choose between two shapes of an emoji; they and typographic quotes, dashes and dots stay.
KEPT = {0xFE0E, 0xFE0F, 0x2026}
#: A joiner between two pictographs makes one of them and stays; a non-joiner inside a word of Arabic script parts its letters.
PICTOGRAPH = "[\u2190-\u2bff\ufe0f\U0001f000-\U0001faff]"
EMOJI_JOINER = re.compile(f"(?<={PICTOGRAPH})\u200d(?={PICTOGRAPH})")
PARTED = re.compile("[\u0620-\u06ff]+(?:\u200c[\u0620-\u06ff]+)+")
HELD = "\ue000"


@lru_cache(None)
def signs() -> np.ndarray:
    """By code point: which of COMPATIBLE, INVISIBLE and BLANK it is, MARK for a combining mark."""
    t = np.zeros(0x110000, np.uint8)
    for i in range(0x80, 0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs") or i in KEPT:
            continue
        if kind == "Zs" or kind in ("Zl", "Zp"):
            t[i] = BLANK
        elif kind == "Cf":
            t[i] = INVISIBLE
        elif kind in ("Mn", "Mc"):
            t[i] = MARK
        elif kind not in ("Pd", "Pi", "Pf") and unicodedata.decomposition(c).startswith("<"):
            t[i] = COMPATIBLE
    t[[0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0x180B, 0x1810)]] = INVISIBLE
    return t


@lru_cache(None)
def scripts() -> np.ndarray:
    """By code point: the script of a letter, 0 for all else and for letters used in several scripts."""
    t = np.zeros(0x110000, np.uint8)
    for a, b, k in BLOCKS:
        for i in range(a, b):
            if unicodedata.category(chr(i))[0] == "L" and i != 0xB5:
                t[i] = k
    return t


def _rows_with(hit: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts that hold one of these places."""
    return np.unique(np.searchsorted(offs, hit, side="right") - 1)


def _mixed(cps: np.ndarray, offs: np.ndarray, script: np.ndarray) -> dict[int, list[str]]:
    """The mixed-script words of each text that has any."""
    mixed: dict[int, list[str]] = {}
    start, end, text = tk.words(cps, offs)
    if len(start):
        high = np.maximum.reduceat(script, start)
        low = np.minimum.reduceat(np.where(script == 0, 255, script), start)
        # reduceat runs to the next word's start; between words there are no letters
        for w in np.flatnonzero((high > 0) & (low < high)):
            mixed.setdefault(int(text[w]), []).append("".join(map(chr, cps[start[w] : end[w]])))
    return mixed


def _pictograph(c: np.ndarray) -> np.ndarray:
    return ((c >= 0x2190) & (c <= 0x2BFF)) | (c == 0xFE0F) | ((c >= 0x1F000) & (c <= 0x1FAFF))


def look(texts: pa.Array, model: langid.Model | None, by_sentence: bool = True) -> tuple[np.ndarray, dict[int, list[str]]]:
    """(kinds of oddities of each text as bits, the mixed-script words of those that have any)."""
    cps, offs = tk.codepoints(texts)
    out = np.zeros(len(texts), np.uint8)
    mixed: dict[int, list[str]] = {}
    if not len(cps):
        return out, mixed
    odd = signs()[cps]
    joins = np.flatnonzero(cps == 0x200D)
    joins = joins[(joins > 0) & (joins < len(cps) - 1)]
    if len(joins):
        odd[joins[_pictograph(cps[joins - 1]) & _pictograph(cps[joins + 1]) & ~np.isin(joins, offs) & ~np.isin(joins + 1, offs)]] = 0
    for bit in (COMPATIBLE, INVISIBLE, BLANK):
        out[_rows_with(np.flatnonzero(odd == bit), offs)] |= bit
    for i in _rows_with(np.flatnonzero(odd == MARK), offs):
        t = texts[int(i)].as_py()
        if unicodedata.normalize("NFC", t) != t:
            out[i] |= MARK
    script = scripts()[cps]
    foreign = script > LATIN
    if foreign.any():
        mixed = _mixed(cps, offs, script)
        out[list(mixed)] |= FOREIGN
        forms = np.isin(cps, [ord(c) for x in (YEH, KAF) for c in x.values()])
        if forms.any() and model is not None:
            arabic_form = np.isin(cps, [ord(YEH["ar"]), ord(KAF["ar"])])
            starts = langid.segments(cps, offs) if by_sentence else offs[:-1][np.diff(offs) > 0]
            persian = _is_persian(model, cps, offs, starts)
            at = np.flatnonzero(forms)
            wrong = at[persian[np.searchsorted(starts, at, side="right") - 1] == arabic_form[at]]
            out[_rows_with(wrong, offs)] |= PERSIAN_ARABIC
    return out, mixed


def _is_persian(model: langid.Model, cps: np.ndarray, offs: np.ndarray, starts: np.ndarray, least: int = 15) -> np.ndarray:
    """For each stretch, whether its Arabic-script text is Persian rather than Arabic. The profile doesn't tell the forms of
    yeh and kaf apart, so they have no say; a stretch with few letters goes with the one before it, or with the next if it is the
    first or the beginning of a sentence that is broken over lines, or with its whole text."""
    fa, ar = langid.LANGUAGES.index("fa"), langid.LANGUAGES.index("ar")
    cosines, n = model.score(cps, offs, starts)
    lead = (cosines[:, fa] - cosines[:, ar]) * np.sqrt(np.maximum(1, n))
    row = np.searchsorted(offs, starts, side="right") - 1
    whole = np.bincount(row, weights=lead, minlength=len(offs) - 1)
    near, size = lead.copy(), n.copy()
    same = row[1:] == row[:-1]
    dark = np.maximum.accumulate(np.where(np.isin(cps, [32, 10, 13, 9, 34]), 0, np.arange(len(cps))))
    closed = np.isin(cps[dark[np.append(starts[1:], len(cps)) - 1]], langid.ENDS)
    opens = np.append(True, ~same | (closed[:-1] & ~closed[1:]))[: len(row)]
    near[1:] += np.where(same & ~opens[1:], lead[:-1], 0)
    near[:-1] += np.where(same & opens[:-1], lead[1:], 0)
    size[1:] += np.where(same & ~opens[1:], n[:-1], 0)
    size[:-1] += np.where(same & opens[:-1], n[1:], 0)
    return np.where(n >= least, lead, np.where(size >= least, near, whole[row])) > 0


def _scan(models: object, fields: list[tuple[str, bool]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, fields[0][0]):
                ids, names, bits, words = [], [], [], []
                for (name, is_list), model in zip(fields, models.value, strict=True):
                    col = batch.column(name)
                    if is_list:
                        col = pa.array([None if c is None else "\n".join(x for x in c if x is not None) for c in col.to_pylist()], pa.string())
                    found, mixed = look(col, model, not is_list)
                    for i in np.flatnonzero(found):
                        ids.append(batch.column("id")[int(i)].as_py())
                        names.append(name)
                        bits.append(int(found[i]))
                        words.append(sorted(set(mixed.get(int(i), ()))))
                yield pa.record_batch(
                    [pa.array(ids, batch.schema.field("id").type), pa.array(names, pa.string()), pa.array(bits, pa.int32()), pa.array(words, pa.list_(pa.string()))], ["id", "field_name", "kinds", "words"]
                )

    return run


def fit_models(df: DataFrame, id_col: str, fields: dict[str, str | None], per_language: int = 1000, seed: int = 0) -> list[langid.Model | None]:
    """For each field the profile that tells Persian from Arabic, None for fields without a label. One profile serves all,
    fitted on about per_language labelled rows of each field and language (see langid), as short options alone teach little."""
    parts = []
    for name, label in fields.items():
        if label is not None:
            is_list = df.schema[name].dataType.simpleString().startswith("array")
            text = F.concat_ws(" | ", F.col(name)) if is_list else F.col(name)
            named = df.where(text.rlike("[\\u0600-\\u06ff]") & langid.label_code(F.col(label)).isin("fa", "ar"))
            parts.append(langid._sample(named, text, F.col(label), id_col, per_language, seed))
    labels = np.concatenate([of for _, of in parts]) if parts else np.zeros(0, np.int64)
    model = langid.Model(seed=seed).fit(pa.concat_arrays([t for t, _ in parts]), labels) if len(set(labels)) == 2 else None
    return [None if label is None else model for label in fields.values()]


def find_lookalikes(df: DataFrame, id_col: str, fields: dict[str, str | None], models: list | None = None) -> DataFrame:
    """(id, field_name, kinds, words): each field (text, or list of texts, taken together) that holds a character with a
    compatibility form, a mark where a composed letter exists, an invisible character, a blank other than the space, a letter
    of another script inside a word, or yeh or kaf in the form of the other of Persian and Arabic. fields maps each to the
    column of its language label or None; the labels of all fields together must name both Persian and Arabic, else the two can't
    be told apart and yeh and kaf are not looked at. kinds has a bit for each of KINDS, words are the mixed-script words.

    Tabs and line breaks, typographic quotes, dashes and dots, emoji selectors and whole words in another script are
    ordinary. Null and empty fields hold nothing. One pass without a shuffle.
    """
    models = models or fit_models(df, id_col, fields)
    shared = df.sparkSession.sparkContext.broadcast(models)
    kinds = [(f, df.schema[f].dataType.simpleString().startswith("array")) for f in fields]
    rows = df.select(F.col(id_col).alias("id"), *fields)
    return rows.mapInArrow(_scan(shared, kinds), f"id {rows.schema['id'].dataType.simpleString()}, field_name string, kinds int, words array<string>")


def substitutes(word: str) -> list[str]:
    """A mixed-script word in one script, its dominant one (that of most of its letters) first: letters of other scripts are
    replaced by their look-alikes. A script in which a letter has none gives no candidate."""
    table = scripts()
    of = [int(table[ord(c)]) for c in word]
    counts = {s: of.count(s) for s in set(of) - {0}}
    out = []
    for target in sorted(counts, key=lambda s: (-counts[s], s)):
        there = {LATIN: LATIN_OF, CYRILLIC: CYRILLIC_OF, GREEK: GREEK_OF}.get(target, {})
        letters = [c if s in (0, target) else there.get(c, there.get(LATIN_OF.get(c, ""), "")) for c, s in zip(word, of, strict=True)]
        if all(letters):
            out.append("".join(letters))
    return out


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each slice by their hash: clean ones only, neither mixed-script words nor pieces beside an invisible
    sign, so a word to repair is no evidence for itself."""
    for whole in batches:
        for batch in tk.slices(whole, "text"):
            cps, offs = tk.codepoints(batch.column("text"))
            start, end, _ = tk.words(cps, offs)
            if not len(start):
                continue
            script = scripts()[cps]
            high = np.maximum.reduceat(script, start)
            low = np.minimum.reduceat(np.where(script == 0, 255, script), start)
            hidden = np.concatenate([[False], signs()[cps] == INVISIBLE, [False]])
            clean = ((high == 0) | (low >= high)) & ~hidden[start] & ~hidden[end + 1]
            yield pa.record_batch([pa.array(np.unique(tk.word_hashes(cps, start[clean], end[clean])).view(np.int64))], ["word"])


def word_key(words: list[str]) -> list[int]:
    cps, offs = tk.codepoints(pa.array(words, pa.string()))
    return tk.Rolling(tk.lower()[cps], 1).of(offs[:-1], offs[1:]).view(np.int64).tolist()


@lru_cache(None)
def _patterns() -> tuple:
    table = signs()
    drop = "".join(map(chr, np.flatnonzero(table == INVISIBLE)))
    blank = "".join(map(chr, np.flatnonzero(table == BLANK)))
    compatible = "".join(map(chr, np.flatnonzero(table == COMPATIBLE)))
    return regex.compile(f"[{regex.escape(drop, special_only=False)}]"), regex.compile(f"[{regex.escape(blank, special_only=False)}]"), frozenset(compatible)


@lru_cache(None)
def _marked() -> re.Pattern:
    """A word with the combining marks on its letters."""
    marks = re.escape("".join(map(chr, np.flatnonzero(signs() == MARK))))
    return re.compile(f"[^\\W_](?:[^\\W_]|[{marks}])*")


def plain(text: str) -> str:
    """Invisible signs dropped, blanks to spaces, compatibility forms and marks to ordinary letters."""
    drop, blank, compatible = _patterns()
    if "\u200d" in text and HELD not in text:
        text = drop.sub("", EMOJI_JOINER.sub(HELD, text)).replace(HELD, "\u200d")
    else:
        text = drop.sub("", text)
    text = blank.sub(" ", text)
    return unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) if c in compatible else c for c in text))


def words_to_replace(texts: list[str]) -> list[list[str]]:
    """The mixed-script words of each plain text, those with marks that no composed letter holds as wholes and in their parts."""
    col = pa.array(texts, pa.string())
    cps, offs = tk.codepoints(col)
    script = scripts()[cps]
    mixed = _mixed(cps, offs, script) if (script > LATIN).any() else {}
    for i in _rows_with(np.flatnonzero(signs()[cps] == MARK), offs):
        found = [w for w in _marked().findall(texts[int(i)]) if not w.isascii() and len({int(scripts()[ord(c)]) for c in w} - {0}) > 1]
        if found:
            mixed.setdefault(int(i), []).extend(found)
    return [sorted(set(mixed.get(i, ()))) for i in range(len(texts))]


def proposals(word: str) -> list[tuple[int, str, list[str]]]:
    """(rank, text to put, words that must stand in the vocabulary for it) of a word to replace: the forms of a mixed-script
    word in one script, its dominant one first; of a parted word the whole, then its parts with blanks."""
    if "\u200c" in word:
        parts = word.split("\u200c")
        return [(0, "".join(parts), ["".join(parts)] * 2), (1, " ".join(parts), [parts[0], parts[-1]])]
    forms = [unicodedata.normalize("NFC", s) for s in substitutes(word)]
    return [(k, s, [s, s]) for k, s in enumerate(forms)]


def repair(text: str, words: dict[str, str], persian: bool | None = None) -> str:
    """The text in its consistent form: made plain, mixed-script and parted words by the given table (a parted word that is not
    in it becomes one), and yeh and kaf as the language has them."""
    if "\u200c" in text:
        text = PARTED.sub(lambda m: words.get(m[0], m[0]), text)
    text = plain(text)
    if words:
        text = _marked().sub(lambda m: words.get(m[0]) or tk.WORD.sub(lambda w: words.get(w[0], w[0]), m[0]), text)
        text = unicodedata.normalize("NFC", text)
    if persian is not None:
        a, b = ("ar", "fa") if persian else ("fa", "ar")
        text = text.replace(YEH[a], YEH[b]).replace(KAF[a], KAF[b])
    return text


def repair_lookalikes(df: DataFrame, id_col: str, fields: dict[str, str | None]) -> DataFrame:
    """(id, field_name, kinds, text, changed, unsolved): the fields that find_lookalikes names, in their consistent form (a list as
    a JSON array), whether that differs from what they hold, and their mixed-script words for which there was none.

    Each word's dominant script is that of most of its letters. A mixed-script word is replaced only if the word that comes out
    stands somewhere in the fields of df, in its dominant
    script if that is there, else in another; words are looked up in lower case, as they are once the field is plain. A
    non-joiner inside a word of Arabic script goes if the whole is a word elsewhere, else it becomes a blank if its parts are,
    else it goes. Rows without an id are left out, and a row that repeats an id adds nothing. kinds tells what the field had before. The vocabulary is joined by hashes, never collected: a row brings only the replacements of its own words.
    """
    df = df.where(F.col(id_col).isNotNull())
    models = fit_models(df, id_col, fields)
    found = find_lookalikes(df, id_col, fields, models).groupBy("id", "field_name").agg(F.bit_or("kinds").alias("kinds"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                fields_of = zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True)
                raw = ["\n".join(x for x in ([t] if parts is None else parts) if x is not None) for t, parts in fields_of]
                words = words_to_replace([plain(t) for t in raw])
                words = [[*own, *sorted(set(PARTED.findall(t)))] if "\u200c" in t else own for own, t in zip(words, raw, strict=True)]
                yield pa.record_batch([*batch.columns, pa.array(words, pa.list_(pa.string()))], [*batch.schema.names, "words"])

    cells = []
    for f in fields:
        is_list = df.schema[f].dataType.simpleString().startswith("array")
        none = F.lit(None)
        cells.append(F.struct(F.lit(f).alias("field_name"), (none.cast("string") if is_list else F.col(f)).alias("text"), (F.col(f) if is_list else none.cast("array<string>")).alias("parts")))
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*cells)).alias("c")).select("id", "c.*")
    kind = df.schema[id_col].dataType.simpleString()
    found = stage(found, "lookalike-fields")
    long = likely_in(long, "id", found.select("id"))
    odd = long.join(found, ["id", "field_name"]).dropDuplicates(["id", "field_name"]).mapInArrow(collect, f"id {kind}, field_name string, text string, parts array<string>, kinds int, words array<string>")
    odd = stage(odd, "lookalikes")
    # words are matched as they are after the other repairs
    words = odd.select(F.explode("words").alias("word")).distinct()

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(w, k, s, of) for w in batch.column("word").to_pylist() for k, s, of in proposals(w)]
            keys = [word_key([of[i] for *_, of in made]) for i in (0, 1)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            columns = ([w for w, *_ in made], [k for _, k, *_ in made], [s for _, _, s, _ in made], *keys)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "rank", "sub", "key", "last"])

    text_of = {f: F.concat_ws("\n", F.col(f)) if df.schema[f].dataType.simpleString().startswith("array") else F.col(f) for f in fields}
    texts = df.select(F.explode(F.array(*text_of.values())).alias("text")).where(F.col("text").isNotNull())
    sought = stage(words.mapInArrow(propose, "word string, rank int, sub string, key bigint, last bigint"), "lookalike-proposals")
    keys = sought.select("key").union(sought.select("last")).distinct()
    vocabulary = stage(likely_in(texts.mapInArrow(_vocabulary, "key bigint"), "key", stage(keys, "lookalike-keys")).distinct(), "lookalike-vocabulary")
    known = sought.join(vocabulary, "key", "left_semi").join(vocabulary.withColumnRenamed("key", "last"), "last", "left_semi")
    chosen = known.groupBy("word").agg(F.min_by("sub", "rank").alias("sub"))
    per_row = odd.select("id", "field_name", F.explode("words").alias("word")).join(chosen, "word").groupBy("id", "field_name").agg(F.map_from_entries(F.collect_set(F.struct("word", "sub"))).alias("subs"))
    shared = df.sparkSession.sparkContext.broadcast(dict(zip(fields, models, strict=True)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            out, changed, unsolved = [], [], []
            for name, kinds, text, parts, subs, words in zip(*(batch.column(c).to_pylist() for c in ("field_name", "kinds", "text", "parts", "subs", "words")), strict=True):
                table, model = dict(subs or ()), shared.value[name]
                pieces = [text] if parts is None else parts
                asked = bool(kinds & PERSIAN_ARABIC) and model is not None
                fixed = None
                if asked:
                    whole = "\n".join(x for x in pieces if x is not None)
                    cps, offs = tk.codepoints(pa.array([whole]))
                    starts = langid.segments(cps, offs) if parts is None else offs[:-1]
                    persian = _is_persian(model, cps, offs, starts)
                    if parts is None:
                        fixed = ["".join(repair(whole[a:b], table, bool(p)) for a, b, p in zip(starts, [*starts[1:], len(whole)], persian, strict=True))]
                    else:  # the options of a list are of one language
                        fixed = [None if x is None else repair(x, table, bool(persian[0])) for x in pieces]
                fixed = [None if x is None else repair(x, table) for x in pieces] if fixed is None else fixed
                changed.append(fixed != pieces)
                unsolved.append([w for w in words if w not in table and "\u200c" not in w])
                out.append(fixed[0] if parts is None else json.dumps(fixed, ensure_ascii=False))
            yield pa.record_batch(
                [*(batch.column(c) for c in ("id", "field_name", "kinds")), pa.array(out, pa.string()), pa.array(changed, pa.bool_()), pa.array(unsolved, pa.list_(pa.string()))],
                ["id", "field_name", "kinds", "text", "changed", "unsolved"],
            )

    rows = odd.join(per_row, ["id", "field_name"], "left")
    return rows.mapInArrow(apply, f"id {kind}, field_name string, kinds int, text string, changed boolean, unsolved array<string>")
