"""Personal-data spans: taggers, tag decoding, filters, a backstop for phone numbers, windows, redaction."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import textkernel as tk

# Patterns of the recognisers, the least digits a span of a label must have, labels whose digits may be spelled,
# what is cut from the ends of a span, one-letter words that Arabic joins to the next, and digit and letter forms.
PATTERNS = {
    "EMAIL": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}",
    "IP_ADDRESS": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{N}.]*\p{N})",
    "CARD": r"(?<![\p{N}-])\d(?:[ -]?\d){12,18}(?![\p{N}-])",
    "IBAN": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
}
MIN_DIGITS = {"PHONE": 6, "CARD": 12, "IBAN": 10, "NATIONAL_ID": 5, "PASSPORT": 5, "DATE_OF_BIRTH": 2, "IP_ADDRESS": 4}
SPELLED = ("PHONE", "NATIONAL_ID")
LEADING, TRAILING, MARKS = "«\"'", ".,;:!?،؛؟»)\"'۔", "\u200e\u200f\u200c"
CLITICS = "وبلفكس"
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve double triple twenty thirty forty fifty sixty seventy eighty ninety hundred",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun", "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "tr": "sıfır bir iki üç dört beş altı yedi sekiz dokuz", "ru": "ноль один два три четыре пять шесть семь восемь девять", "ar": "صفر واحد اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة", "fa": "صفر یک دو سه چهار پنج شش هفت هشت نه",
}
VERSIONS = ("v1", "v2", "v2.1")

COMPILED = {k: regex.compile(v) for k, v in PATTERNS.items()}
GUARD = r"@|\p{Nd}[ \x{a0}()./-]{0,3}\p{Nd}[ \x{a0}()./-]{0,3}\p{Nd}|\p{Nd}\.\p{Nd}"
SPAN = "array<struct<start:int,end:int,label:string,text:string>>"
ITEM = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string())])
Span = tuple[int, int, str]
#: Texts of a batch to the (start, end) of each one's tokens and their begin, inside and outside tags.
Tagger = Callable[[list[str]], list[tuple[list[tuple[int, int]], list[str]]]]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def trim_span(text: str, start: int, end: int, initials: bool = False) -> tuple[int, int]:
    """The span without blanks, marks and punctuation around it. With initials a full stop after a single last letter stays."""
    head, tail = LEADING + MARKS, TRAILING + MARKS
    body = text[start:end]
    kept = body.lstrip()
    while kept and kept[0] in head:
        kept = kept[1:].lstrip()
    start = end - len(kept)
    while kept and (kept[-1].isspace() or kept[-1] in tail):
        if initials and regex.search(r"(?:^|[ .\u00a0])\p{L}\.$", kept):
            break
        kept = kept[:-1]
    return start, start + len(kept)


def tag_runs(place: np.ndarray, label: np.ndarray, blank: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) token of every span, over the tokens of many texts at once. place is 0 outside, 1 inside, 2 at a beginning;
    label numbers; blank tokens that are outside neither end nor begin anything; row is each token's text."""
    live = np.flatnonzero(~(blank & (place == 0)))
    p, k, r = place[live], label[live], row[live]
    inside = p > 0
    goes_on = np.zeros(len(live), bool)
    goes_on[1:] = (p[1:] == 1) & inside[:-1] & (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    first = np.flatnonzero(inside & ~goes_on)
    last = np.flatnonzero(inside & ~np.append(goes_on[1:], False))
    return live[first], live[last]


def decode_tags(text: str, offsets: list[tuple[int, int]], tags: list[str], initials: bool = False) -> list[Span]:
    """Begin-inside-outside tags of tokens to character spans: an outside tag over blanks doesn't end a span, tokens without
    width are passed over, and a begin tag, another label or an inside tag without a beginning starts a span."""
    wide = [(o, t) for o, t in zip(offsets, tags, strict=True) if o[0] < o[1]]
    names = {t[2:]: i for i, t in enumerate(sorted({t for _, t in wide}))}
    place = np.array(["OIB".index(t[0]) for _, t in wide], np.int64)
    label = np.array([names[t[2:]] for _, t in wide], np.int64)
    blank = np.array([not text[a:b].strip() for (a, b), _ in wide], bool)
    out = []
    for i, j in zip(*tag_runs(place, label, blank, np.zeros(len(wide), np.int64)), strict=True):
        name = wide[i][1][2:]
        a, b = trim_span(text, wide[i][0][0], wide[j][0][1], initials and name == "PERSON_NAME")
        if a < b:
            out.append((a, b, name))
    return out


@lru_cache(None)
def _number_words() -> frozenset[str]:
    return frozenset(w for words in NUMBER_WORDS.values() for w in words.split())


def digit_count(body: str, spelled: bool = False) -> int:
    """Digits of any script; a number word counts as two if they may be spelled."""
    n = sum(c.isdecimal() for c in body)
    return n + 2 * sum(w.lower() in _number_words() for w in regex.findall(r"\p{L}+", body)) if spelled else n


def keep_span(text: str, start: int, end: int, label: str, spelled: bool = True) -> bool:
    """Enough digits for its label, an @ in an address, names and places of two characters, and not cut inside a word, but for
    a one-letter word that Arabic joins to the next."""
    body = text[start:end]
    if digit_count(body, spelled and label in SPELLED) < MIN_DIGITS.get(label, 0):
        return False
    if (label == "EMAIL" and "@" not in body) or (label in ("PERSON_NAME", "ADDRESS") and len(body) < 2):
        return False
    joined = start > 0 and text[start - 1].isalnum() and body[0].isalnum()
    if joined and text[start - 1] in CLITICS and not (start > 1 and text[start - 2].isalnum()):
        joined = False
    return not joined and not (end < len(text) and text[end].isalnum() and body[-1].isalnum())


# Runs of digits


@dataclass
class DigitRuns:
    """Runs of groups of digits that little stands between, over the texts of a batch: arrays with one entry a group (start,
    end, run) and one a run (text, first, count)."""

    start: np.ndarray
    end: np.ndarray
    run: np.ndarray
    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    cps: np.ndarray

    @cached_property
    def gaps(self) -> list[np.ndarray]:
        """For the gap after each group: its size, and how many of - . / and of points alone it holds (size -1 after the last)."""
        nxt = np.append(self.start[1:], 0)
        size = np.where(np.append(self.run[1:] == self.run[:-1], False), nxt - self.end, -1) if len(self.start) else np.zeros(0, np.int64)
        sign = np.concatenate([[0], np.cumsum(np.isin(self.cps, SIGNS))])
        point = np.concatenate([[0], np.cumsum(self.cps == ord("."))])
        ends = np.where(size >= 0, nxt, self.end)
        return [size, sign[ends] - sign[self.end], point[ends] - point[self.end]]

    def per_run(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.run, weights=values, minlength=len(self.first)).astype(np.int64)

    @cached_property
    def kinds(self) -> np.ndarray:
        """date (three groups with one sign between, of the lengths of a day, month and year), card (three or more groups of
        four), address (three or more points), or plain, of each run."""
        length = self.end - self.start
        size, sign, point = self.gaps
        inner = size >= 0
        card = (self.count >= 4) & (self.per_run(length == 4) >= 3)
        address = self.per_run(np.where(inner, point > 0, False)) >= 3
        three = np.flatnonzero(self.count >= 3)
        a = self.first[three]
        signed = (size[a] == 1) & (sign[a] == 1) & (size[a + 1] == 1) & (sign[a + 1] == 1)
        x, y, z = length[a], length[a + 1], length[a + 2]
        date = np.zeros(len(self.first), bool)
        date[three] = signed & (((x <= 2) & (y <= 2) & ((z == 2) | (z == 4))) | ((x == 4) & (y <= 2) & (z <= 2)))
        return np.select([card, date, address], ["card", "date", "address"], "plain")


SIGNS, LIGHT = [ord(c) for c in "-./"], [ord(c) for c in " \u00a0()"]


@lru_cache(None)
def _is_digit() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    for i in range(0x20000):
        t[i] = chr(i).isdecimal()
    return t


def digit_runs(cps: np.ndarray, offs: np.ndarray) -> DigitRuns:
    """Groups of digits belong to one run where at most three signs stand between them, at most one of them - . or /, the
    others blanks or brackets."""
    digit = _is_digit()[cps]
    edge = np.concatenate([[0], digit.astype(np.int8), [0]])
    turn = np.diff(edge)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    cut = offs[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(cps))])
    cut = cut[digit[cut] & digit[cut - 1]]  # digits on both sides of the border of two texts
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    text = np.searchsorted(offs, start, side="right") - 1
    sign = np.concatenate([[0], np.cumsum(np.isin(cps, SIGNS))])
    light = np.concatenate([[0], np.cumsum(np.isin(cps, LIGHT))])
    gap = start[1:] - end[:-1]
    signs, lights = sign[start[1:]] - sign[end[:-1]], light[start[1:]] - light[end[:-1]]
    near = (text[1:] == text[:-1]) & (gap <= 3) & (signs <= 1) & (signs + lights == gap) & (gap > 0)
    new = np.append(True, ~near)[: len(start)]
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return DigitRuns(start, end, run, text[first], first, np.bincount(run, minlength=len(first)), cps)


# Words around numbers


def word_key(word: str) -> str:
    """Lower case without marks, letters of Arabic script in one form."""
    bare = "".join(c for c in word.lower() if not unicodedata.combining(c))
    return bare.translate(str.maketrans(T.LETTER_VARIANTS + "ے", T.LETTER_FORMS + "ی"))


@dataclass(frozen=True)
class WordList:
    """Words and phrases to look up by key. An entry's last words may be marked: `*` allows up to three more letters, `_` parts the
    words of a phrase. Words in Arabic script are also found behind joined particles."""

    entries: str
    particles: tuple[str, ...] = ("", "و", "ب", "ل", "ف", "ال", "وال", "بال", "لل", "فال")

    @cached_property
    def table(self) -> dict[str, list[tuple[tuple[str, ...], bool]]]:
        out: dict[str, list[tuple[tuple[str, ...], bool]]] = {}
        for e in self.entries.split():
            words = tuple(word_key(w) for w in e.rstrip("*").split("_"))
            out.setdefault(words[0], []).append((words, e.endswith("*")))
        return out

    def _forms(self, key: str) -> Iterator[tuple[str, int]]:
        """What an entry's word may be for this key, with the letters it has more."""
        arabic = key[:1] >= "\u0600"
        for p in self.particles if arabic else ("",):
            if key.startswith(p) and len(key) > len(p):
                for more in range(0, min(4, len(key) - len(p))):
                    yield key[len(p) : len(key) - more], more

    def at(self, tokens: list[tuple[int, int, str]], i: int) -> int:
        """How many tokens from i on an entry takes; 0 for none. Words of a phrase are at most two characters apart."""
        best = 0
        for form, more in self._forms(tokens[i][2]):
            for words, open_ in self.table.get(form, ()):
                n = len(words)
                if (more and not (open_ and n == 1)) or i + n > len(tokens) or n <= best:
                    continue
                rest = tokens[i + 1 : i + n]
                near = all(b[0] - a[1] <= 2 for a, b in zip(tokens[i : i + n], rest))
                if near and all(t[2] == w or (open_ and k == n - 2 and t[2].startswith(w) and len(t[2]) - len(w) <= 3) for k, (t, w) in enumerate(zip(rest, words[1:], strict=True))):
                    best = n
        return best


@dataclass(frozen=True)
class PhoneRules:
    """What the backstop goes by; all of it may be given. countries maps a calling code to the first digits and the lengths of
    its national numbers; a national number begins with `trunk` or has such a length itself."""

    cues: WordList = field(default_factory=lambda: WordList(
        "phone* telephone* mobile* cell cellphone tel call dial text whatsapp* my_number telefon* handy* mobil* rufnummer anrufen téléphone* portable* appelez teléfono* móvil* llámame "
        "телефон* мобильн* звоните cep gsm numaram* arayın هاتف* جوال* موبايل* تلفون* واتساب* رقمي اتصل* تلفن* موبایل* تماس* شماره_من شماره_همراه واتساپ*"))  # fmt: skip
    blockers: WordList = field(default_factory=lambda: WordList(
        "order* invoice* account* card* id ticket* case batch page room version* tracking reference serial model* price* amount* total code password pin booking* contract* customer* "
        "bestellung* rechnung* konto* kunden* commande* facture* compte* pedido* factura* cuenta* заказ* счёт* договор* sipariş* fatura* hesap* kart* müşteri* طلب* فاتور* حساب* بطاق* رقم_الطلب سفارش* فاکتور* کارت* کد"))  # fmt: skip
    units: WordList = field(default_factory=lambda: WordList("eur usd gbp euro* dollar* tl lira rub руб* ريال* درهم* تومان kg mb gb points puntos punkte credits"))
    joiners: WordList = field(default_factory=lambda: WordList("or and oder und ou o y или ve veya او و یا"))
    countries: tuple[tuple[str, str, int, int], ...] = (
        ("1", "23456789", 10, 10), ("7", "3489", 10, 10), ("20", "12345689", 8, 10), ("31", "123456789", 9, 9), ("33", "123456789", 9, 9), ("34", "6789", 9, 9), ("39", "03", 8, 11), ("41", "234567", 9, 9),
        ("43", "123456789", 7, 13), ("44", "1237", 9, 10), ("49", "123456789", 7, 11), ("61", "2478", 9, 9), ("81", "123456789", 9, 10), ("86", "1", 11, 11), ("90", "2345", 10, 10), ("91", "6789", 10, 10), ("92", "234589", 9, 10),
        ("98", "123456789", 10, 10), ("212", "567", 9, 9), ("213", "23567", 8, 9), ("216", "23456789", 8, 8), ("961", "3456789", 7, 8), ("962", "2345678", 8, 9), ("963", "1234589", 8, 9), ("964", "1234567", 8, 10), ("965", "2569", 8, 8),
        ("966", "15", 9, 9), ("968", "279", 8, 8), ("971", "23456789", 8, 9), ("973", "136", 8, 8), ("974", "34567", 8, 8),
    )
    trunk: str = "0"
    toll_free: tuple[str, ...] = ("800", "0800", "0850", "0845", "0870", "0871", "0900", "1800", "1855", "1866", "1877", "1888")

    @cached_property
    def _codes(self) -> dict[str, tuple[str, str, int, int]]:
        return {c[0]: c for c in self.countries}

    @cached_property
    def _national(self) -> frozenset[tuple[str, int]]:
        """First digits and lengths of national numbers without their trunk digit."""
        return frozenset((h, n) for _, heads, low, high in self.countries for h in heads for n in range(low, high + 1))

    def _abroad(self, digits: str) -> bool | None:
        """Whether it is a number of the country whose code it begins with; None for a code that is not listed."""
        for n in (3, 2, 1):
            if (found := self._codes.get(digits[:n])) is not None:
                code, heads, low, high = found
                own = digits[len(code) :].removeprefix(self.trunk)
                return low <= len(own) <= high and own[:1] in heads
        return None

    def is_number(self, digits: str, plus: bool) -> bool:
        if plus or digits.startswith("00"):
            own = digits.removeprefix("00")
            known = self._abroad(own)
            return (8 <= len(own) <= 15 and not own.startswith("0")) if known is None else known
        if digits.startswith(self.toll_free):
            return False
        if digits.startswith(self.trunk):
            return (digits[1:2], len(digits) - 1) in self._national
        return len(digits) >= 8 and ((digits[0], len(digits)) in self._national or bool(self._abroad(digits)))


RULES = PhoneRules()
TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
# What may not touch a phone number (a letter, digit or sign, a code's hyphen, a time's colon), what ends a clause,
# and how far words reach, in characters and in words.
TOUCHES_BEFORE = regex.compile(r"(?:[\p{L}\p{N}/=#@_&?$€£₺%]|[\p{L}\p{N}][-./])$")
TOUCHES_AFTER = regex.compile(r"[\p{L}\p{N}$€£₺%@]|:\p{Nd}")
CLAUSE_END = regex.compile(r"[;؛!?]|(?<!^)\.")
STOP = regex.compile(r"[.,،؛;!?\n|]")
REACH, REACH_BACK, FILLERS, BLOCKER_REACH, CHAIN_REACH = 25, 12, 3, 24, 8
Token = tuple[int, int, str]


def word_tokens(text: str, start: int = 0) -> list[Token]:
    return [(start + m.start(), start + m.end(), word_key(m[0])) for m in TOKEN.finditer(text)]


def _numeric(t: Token) -> bool:
    return any(c.isdecimal() for c in t[2])


def cue_ranges(text: str, tokens: list[Token], rules: PhoneRules) -> list[tuple[int, int, int, int]]:
    """What each phone word of a text reaches: (least and greatest place where a number after it may begin, least and greatest
    place where one before it may end). A word that stands behind one for another kind of number, close by in its clause,
    reaches nothing. Forward, the reach ends at the first token with digits, at a word for another kind of number, at the end
    of the clause, or before a fourth word; backward at a line break, and nothing if a number follows the word."""
    out = []
    i = 0
    while i < len(tokens):
        n = rules.cues.at(tokens, i)
        if not n:
            i += 1
            continue
        begin, end = tokens[i][0], tokens[i + n - 1][1]
        clause = max((m.end() for m in STOP.finditer(text, max(0, begin - BLOCKER_REACH), begin)), default=0)
        near = (k for k in range(max(0, i - BLOCKER_REACH), i) if tokens[k][0] >= max(clause, begin - BLOCKER_REACH))
        after = tokens[i + n : i + n + FILLERS + 1]
        i += n
        if any(rules.blockers.at(tokens, k) for k in near):
            continue
        stop = CLAUSE_END.search(text[end : end + REACH + 1])
        upto = min(end + REACH, end + stop.start() if stop else end + REACH)
        for k, t in enumerate(after):
            if _numeric(t) or k == FILLERS or rules.blockers.at(after, k):
                upto = min(upto, t[0] if _numeric(t) else t[0] - 1)
                break
        line = text.rfind("\n", max(0, begin - REACH_BACK), begin)
        back = begin + 1 if any(map(_numeric, after[:FILLERS])) else max(begin - REACH_BACK, line + 1)
        out.append((end, upto, back, begin))
    return out


def numbers_in(text: str, groups: list[tuple[int, int]], rules: PhoneRules) -> list[tuple[int, int]]:
    """The phone numbers that a run of groups of digits makes: the longest head of the groups that is one, and so on with what is
    left, as long as there is one. A plus or bracket before the first group belongs to it."""
    parts = [text[x:y] if text[x:y].isascii() else "".join(str(unicodedata.decimal(c)) for c in text[x:y]) for x, y in groups]
    plus = groups[0][0] > 0 and text[groups[0][0] - 1] == "+"
    first = groups[0][0] - plus
    first -= first > 0 and text[first - 1] == "(" and ")" in text[first : groups[-1][1]]
    out, at = [], 0
    while at < len(groups):
        sizes = [n for n in range(len(groups) - at, 0, -1) if rules.is_number("".join(parts[at : at + n]), plus and at == 0)]
        if not sizes:
            break
        out.append((groups[at][0] if at else first, groups[at + sizes[0] - 1][1]))
        at += sizes[0]
    return out


def phone_backstop(text: str, spans: list[Span], rules: PhoneRules = RULES, runs: DigitRuns | None = None, own: range | None = None, base: int = 0) -> list[Span]:
    """The spans, and the phone numbers that the tagger missed: numbers (see numbers_in) of runs of digits that are no date, card
    or address, with nothing touching them and no unit after, that a phone word reaches (see cue_ranges), or that follow
    another phone number with nothing but signs or a joining word between. Never changes or overlaps a given span. runs, own
    and base tell where the text's runs are in a batch."""
    if runs is None:
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        runs = digit_runs(cps, np.array([0, len(cps)]))
        own = range(len(runs.first))
    numbers = []
    for r in own:
        if runs.kinds[r] == "plain":
            groups = range(runs.first[r], runs.first[r] + runs.count[r])
            numbers += numbers_in(text, [(int(runs.start[g]) - base, int(runs.end[g]) - base) for g in groups], rules)
    free = [(a, b) for a, b in numbers if not TOUCHES_BEFORE.search(text[max(0, a - 2) : a]) and not TOUCHES_AFTER.match(text, b) and not any(x < b and a < y for x, y, _ in spans)]
    if not free:
        return spans
    tokens = word_tokens(text)
    begins = [t[0] for t in tokens]
    ranges = cue_ranges(text, tokens, rules)
    out = list(spans)
    ends = [b for _, b, k in spans if k == "PHONE"]
    for a, b in sorted(free):
        after = bisect_left(begins, b)
        if after < len(tokens) and begins[after] - b <= 2 and rules.units.at(tokens, after):
            continue
        last = max((e for e in ends if e <= a), default=-CHAIN_REACH - 1)
        gap = text[max(0, last) : a]
        joined = a - last <= CHAIN_REACH and all(rules.joiners.at([t], 0) for t in word_tokens(gap)) and not set(TOKEN.sub("", gap)) - set(" \u00a0,،/-|;؛\n")
        if joined or any(low <= a <= high or back <= b <= begin for low, high, back, begin in ranges):
            out.append((a, b, "PHONE"))
            ends.append(b)
    return sorted(out) if len(out) > len(spans) else spans


def pattern_tagger(texts: list[str]) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """A tagger without a model: the recognisers' patterns, the first one winning; every match is one token. How long the
    longest run of digits is, counted over the whole batch, tells which patterns a text can match at all."""
    cps, offs = tk.codepoints(pa.array(texts, pa.string()))
    runs = digit_runs(cps, offs)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, runs.text, runs.per_run(runs.end - runs.start))
    least = {"EMAIL": 0, "IP_ADDRESS": 4, "CARD": 13, "IBAN": 2}
    out = []
    for t, most in zip(texts, longest.tolist(), strict=True):
        spans: list[Span] = []
        for label, pattern in COMPILED.items():
            if most < least[label] or (label == "EMAIL" and "@" not in t) or (label == "IP_ADDRESS" and "." not in t):
                continue
            for m in pattern.finditer(t):
                a, b = m.span()
                if label == "CARD" and not luhn("".join(c for c in m[0] if c.isdigit())):
                    continue
                if not any(x < b and a < y for x, y, _ in spans):
                    spans.append((a, b, label))
        spans.sort()
        out.append(([(a, b) for a, b, _ in spans], [f"B-{k}" for *_, k in spans]))
    return out


def find_batch(texts: list[str], tagger: Tagger = pattern_tagger, version: str = "v2.1", rules: PhoneRules = RULES) -> list[list[Span]]:
    """Spans of each text: tags, decoded, filtered; from v2 on names keep the full stop of an initial and number words count as
    digits; from v2.1 on the phone backstop adds to them."""
    if version not in VERSIONS:
        raise ValueError(f"version must be one of {VERSIONS}")
    later = version != "v1"
    out = []
    for t, (offsets, tags) in zip(texts, tagger(texts), strict=True):
        out.append([s for s in decode_tags(t, offsets, tags, later) if keep_span(t, *s, spelled=later)])
    if version == "v2.1" and texts:
        cps, offs = tk.codepoints(pa.array(texts, pa.string()))
        runs = digit_runs(cps, offs)
        upto = np.searchsorted(runs.text, np.arange(len(texts) + 1))
        enough = runs.per_run(runs.end - runs.start) >= 6
        for i in np.unique(runs.text[enough]):
            out[i] = phone_backstop(texts[i], out[i], rules, runs, [r for r in range(upto[i], upto[i + 1]) if enough[r]], int(offs[i]))
    return out


def find_spans(text: str, version: str = "v2.1") -> list[Span]:
    return find_batch([text], version=version)[0]


def pii_spans(df: DataFrame, id_col: str, text: str, tagger: Tagger = pattern_tagger, version: str = "v2.1", rules: PhoneRules = RULES, keep: tuple[str, ...] = (), guard: str | None = GUARD) -> DataFrame:
    """(id, keep..., spans) of the texts that have any; the guard, a cheap pattern in the JVM, keeps texts that the tagger finds
    nothing in from leaving it (None lets all through, as a model wants). Offsets are code points of the original text, half open."""
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"_{c}") for c in keep], F.col(text).alias("text")).where(F.col("text").rlike(guard) if guard else F.col("text").isNotNull())
    kept = ["id", *(f"_{c}" for c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                spans = [[{"start": a, "end": b, "label": k, "text": t[a:b]} for a, b, k in own] for t, own in zip(texts, find_batch(texts, tagger, version, rules), strict=True)]
                yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(spans, pa.list_(ITEM))], [*kept, "spans"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), f"spans {SPAN}"])
    return rows.mapInArrow(run, schema).where(F.size("spans") > 0).withColumnsRenamed({f"_{c}": c for c in keep})


def label_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, n): spans by label."""
    return found.select(*keys, F.explode("spans").alias("s")).groupBy(*keys, F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def tagged_segments(df: DataFrame, id_col: str, tokens: str, tags: str) -> DataFrame:
    """(id, start, end, label): spans of texts given as tokens (which put together are the text, blanks included) and their tags.
    Decoded over whole batches; a null list, and lists of unequal length, have no spans."""
    rows = df.select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens"), F.col(tags).alias("tags")).where(F.size("tokens") == F.size("tags"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                words, marks = batch.column("tokens").flatten(), batch.column("tags").flatten().dictionary_encode()
                row = np.repeat(np.arange(batch.num_rows), batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False))
                cps, offs = tk.codepoints(words)
                names = [t or "O" for t in marks.dictionary.to_pylist()]
                code = marks.indices.to_numpy(zero_copy_only=False)
                place = np.array(["OIB".index(t[0]) for t in names] or [0])[code] if len(code) else np.zeros(0, np.int64)
                labels = [t[2:] for t in names]
                number = np.array([labels.index(x) for x in labels] or [0])[code] if len(code) else np.zeros(0, np.int64)
                space = np.isin(cps, [ord(c) for c in " \t\n\r\f\v\u00a0"])
                dark = np.concatenate([[0], np.cumsum(~space)])
                blank = dark[offs[1:]] == dark[offs[:-1]]
                wide = np.flatnonzero(offs[1:] > offs[:-1])
                first, last = (wide[x] for x in tag_runs(place[wide], number[wide], blank[wide], row[wide]))
                begin = offs[np.searchsorted(row, np.arange(batch.num_rows))] if len(row) else offs[:1]
                found = []
                for i, j in zip(first, last, strict=True):
                    body = cps[offs[i] : offs[j + 1]].tobytes().decode("utf-32-le", "surrogatepass")
                    a, b = trim_span(body, 0, len(body), labels[code[i]] == "PERSON_NAME")
                    if a < b:
                        at = int(offs[i] - begin[row[i]])
                        found.append((int(row[i]), at + a, at + b, labels[code[i]]))
                cols = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.record_batch([batch.column("id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["id", "start", "end", "label"])

    return rows.mapInArrow(run, f"id {kind}, start int, end int, label string")


def runs_of_digits(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, start, end, groups, digits, kind) of every run of digits (see digit_runs), kind being date, card, address or plain."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike("\\p{Nd}"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                cps, offs = tk.codepoints(batch.column("text"))
                r = digit_runs(cps, offs)
                begin = offs[r.text]
                ends = r.end[r.first + r.count - 1] if len(r.first) else r.first
                ints = [r.start[r.first] - begin, ends - begin, r.count, r.per_run(r.end - r.start)]
                yield pa.record_batch([batch.column("id").take(pa.array(r.text)), *(pa.array(x.astype(np.int32)) for x in ints), pa.array(r.kinds.astype(str).tolist() if len(r.first) else [], pa.string())], ["id", "start", "end", "groups", "digits", "kind"])

    return rows.mapInArrow(run, f"id {kind}, start int, end int, groups int, digits int, kind string")


def redact(text: Column, spans: Column, form: str = "[{label}]") -> Column:
    """The text with each span replaced by form, from right to left, so offsets stay true."""
    order = F.array_sort(spans, lambda a, b: b["start"] - a["start"])
    pieces = [F.lit(p) for p in regex.split(r"(\{label\}|\{text\})", form)]
    names = regex.split(r"(\{label\}|\{text\})", form)

    def stand_in(s: Column) -> Column:
        return F.concat(*[s["label"] if n == "{label}" else s["text"] if n == "{text}" else p for n, p in zip(names, pieces, strict=True)])

    return F.aggregate(order, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), stand_in(s), F.substring(t, s["end"] + 1, F.length(t))))


def mask_or_block(text: Column, spans: Column, block: bool = False, labels: list[str] | None = None) -> Column:
    """(text, labels): the masked text, or null and the labels found when block is set; labels restricts what counts."""
    own = F.filter(spans, lambda s: s["label"].isin(*labels)) if labels else spans
    names = F.array_sort(F.array_distinct(F.transform(own, lambda s: s["label"])))
    masked = F.when(F.size(own) == 0, text).otherwise(F.lit(None).cast("string") if block else redact(text, own))
    return F.struct(masked.alias("text"), names.alias("labels"))


def window_starts(n: Column, width: int, stride: int) -> Column:
    """First places of the windows over n tokens: every stride, and the last that fits."""
    regular = F.sequence(F.lit(0), n - width - 1, F.lit(stride))
    return F.when(n <= width, F.array(F.lit(0))).otherwise(F.array_append(regular, n - width))


def central_window(k: Column, starts: Column, width: int) -> Column:
    """The window in which token k lies farthest from an edge, the first of equals."""
    holding = F.filter(starts, lambda s: (s <= k) & (k < s + width))
    rated = F.transform(holding, lambda s: F.struct((-F.least(k - s, s + width - 1 - k)).alias("edge"), s.alias("s")))
    return F.array_min(rated)["s"]


def renamed(spans: Column, names: dict[str, str], wanted: list[str] | None = None) -> Column:
    """Spans under other labels; labels without one, and those not wanted, fall away."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    out = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(table, s["label"]).alias("label"), s["text"].alias("text")))
    return F.filter(out, lambda s: s["label"].isin(*wanted) if wanted else s["label"].isNotNull())


def digits_in(c: Column) -> Column:
    """Digits of any script in a text, a number word counting as two."""
    words_ = F.regexp_extract_all(F.lower(c), F.lit("\\p{L}+"), F.lit(0))
    return F.regexp_count(c, F.lit("\\p{Nd}")) + 2 * F.size(F.filter(words_, lambda w: w.isin(*sorted(_number_words()))))
