"""Text normalisers, tokens, hashes and buckets as column expressions. Patterns name Unicode classes and blanks explicitly, so
that they mean the same in Java and in other engines."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.arrays import let

WS = "[ \\t\\n\\r\\f]+"
# The two blocks of digits written in Arabic script, and letters written in several ways there.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
LETTER_VARIANTS = "يىكۀةأإآٱ"
LETTER_FORMS = "ییکههاااا"
TASHKEEL = "[\\x{064B}-\\x{0652}\\x{0670}]"
TATWEEL = "\\x{0640}"
GERMAN_WORDS = ["der", "die", "das", "und", "nicht", "ist", "ein", "eine", "mit", "für"]


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Composed form. Texts that are plain ASCII never leave the JVM."""
    return F.when(c.rlike("[^\\x00-\\x7f]"), F.pandas_udf(_nfc, "string")(c)).otherwise(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS, " "))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS + PERSIAN_DIGITS, "0123456789" * 2)


def fold_letters(c: Column) -> Column:
    """Lower case without combining marks, with the Arabic-script letter variants made one."""
    return F.translate(F.regexp_replace(F.lower(c), "\\p{M}", ""), LETTER_VARIANTS, LETTER_FORMS)


def normalize(c: Column, lang: Column) -> Column:
    """Composed form, trimmed; for fa and ar also without vowel marks and tatweel, with ASCII digits, one form of each letter
    and single blanks."""
    n = nfc(c)
    bare = F.regexp_replace(F.regexp_replace(n, TASHKEEL, ""), TATWEEL, "")
    arabic = F.regexp_replace(F.translate(ascii_digits(bare), "يك", "یک"), "[ \\t]+", " ")
    return F.trim(F.when(lang.isin("fa", "ar"), arabic).otherwise(n))


def norm_gold(c: Column) -> Column:
    """Lower case, single blanks, no quotes around and no end punctuation."""
    return F.regexp_replace(F.regexp_replace(collapse(F.lower(c)), "^[\"'«“]+", ""), "[\"'»”.!?]+$", "")


def norm_web(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), "\\p{Nd}", "0"))


def norm_guard(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "\\p{Nd}", "0"), "[^\\p{L}\\p{N}_]+", " "))


def norm_agent(c: Column) -> Column:
    return collapse(F.lower(F.regexp_replace(F.replace(c, F.lit('\\"'), F.lit('"')), "\\p{Nd}", "0")))


def overlap_key(c: Column) -> Column:
    """Digest of the lower-cased text with single blanks; null below 8 characters, so that short texts never match."""
    n = collapse(F.lower(c))
    return F.when(F.length(n) >= 8, F.substring(F.sha2(n, 256), 1, 24))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_ \\t\\n\\r\\f]"), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def shingles(t: Column, n: int = 3) -> Column:
    """Distinct joined n-grams of a token array."""
    join = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - (n - 1)), lambda i: F.array_join(F.slice(x, i, n), " "))
    return let(t, lambda x: F.when(F.size(x) >= n, F.array_distinct(join(x))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(F.array_union(a, b)))


def guess_language(c: Column) -> Column:
    """By script and, for German, by stop-words: more than a fifth Arabic letters is fa or ar by the letters only one has."""
    count = lambda p: F.regexp_count(c, F.lit(p))
    arabic = count("[\\x{0600}-\\x{06FF}]") > F.length(c) * 0.2
    german = F.size(F.filter(F.split(F.lower(c), "[^\\p{L}]+"), lambda w: w.isin(*GERMAN_WORDS)))
    return (
        F.when(arabic & (count("[پچژگکی]") > count("[ةىيك]")), "fa").when(arabic, "ar").when(count("[\\x{0900}-\\x{097F}]") > 0, "hi").when(count("[\\x{3040}-\\x{30FF}]") > 0, "ja")
        .when(count("[\\x{AC00}-\\x{D7AF}]") > 0, "ko").when(count("[\\x{4E00}-\\x{9FFF}]") > 0, "zh").when(count("[\\x{0400}-\\x{04FF}]") > F.length(c) * 0.2, "ru")
        .when(count("[\\x{0E00}-\\x{0E7F}]") > 0, "th").when(german >= 2, "de").otherwise("en")
    )


def row_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 16)


def _hex8(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def md5_bucket(salt: str, c: Column) -> Column:
    """A number in [0, 1) from the salted MD5."""
    return _hex8(F.md5(F.concat(F.lit(salt + ":"), c))) / F.lit(4294967296.0)


def held_out(c: Column, fraction: float) -> Column:
    return _hex8(F.sha1(c)) / F.lit(4294967295.0) < fraction


def group_bucket(c: Column, n: int = 100) -> Column:
    return F.pmod(_hex8(F.sha1(c)), F.lit(n))


def lenient_json(c: Column) -> Column:
    """The outermost braces of a text that may have a code fence or words around them, if that is valid JSON; else null."""
    inner = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    return F.when(F.json_object_keys(inner).isNotNull(), inner)


def has_keys(state: Column, keys: list[str]) -> Column:
    """Whether a JSON-object state has all keys; texts and other JSON pass."""
    own = F.json_object_keys(state)
    return own.isNull() | (F.size(F.array_except(F.array(*map(F.lit, keys)), own)) == 0)


def cut_at_word(c: Column, n: int = 1500) -> Column:
    """At most n characters, cut at the last blank if that lies in the last fifth, with an ellipsis."""
    head = F.substring(c, 1, n)
    last = F.lit(n + 1) - F.locate(" ", F.reverse(head))
    at = F.when((F.locate(" ", F.reverse(head)) > 0) & (last > n * 0.8), F.substring(head, F.lit(1), last - 1)).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(at, F.lit("…")))


def clip(c: Column, n: int = 6000) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit(" …")))


def pretty_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[_.-]+", " "))


def unwrap_json(c: Column) -> Column:
    """The string values of a flat JSON object joined by blanks; other texts as they are."""
    values = F.map_values(F.from_json(c, "map<string,string>"))
    return F.when(F.json_object_keys(c).isNotNull(), F.array_join(values, " ")).otherwise(c)


def scrub_emails(c: Column, stand_in: str = "user@example.org") -> Column:
    """Addresses become one at a reserved domain; those already at a reserved domain stay."""
    kept = F.regexp_replace(c, "@([A-Za-z0-9.-]+\\.)?(example\\.(?:com|org|net)|[A-Za-z0-9-]+\\.(?:example|test|invalid))\\b", "\x02$1$2")
    return F.translate(F.regexp_replace(kept, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", stand_in), "\x02", "@")


def numbers_kept(before: Column, after: Column) -> Column:
    """Whether after holds each number of before at least as often and no other."""
    x, y = (F.regexp_extract_all(c, F.lit("\\p{Nd}+"), F.lit(0)) for c in (before, after))
    count = lambda a, v: F.size(F.filter(a, lambda w: w == v))
    enough = let(x, lambda p: let(y, lambda q: F.forall(p, lambda v: count(q, v) >= count(p, v))))
    return enough & (F.size(F.array_except(y, x)) == 0)


def verbatim_kept(before: Column, after: Column) -> Column:
    """Whether every path, address, flag and quoted string of before stands in after."""
    kept = F.regexp_extract_all(before, F.lit("https?://[^ \\t\\n\"]+|--?[a-z][a-z-]+|/[A-Za-z0-9_./-]{2,}|\"[^\"]+\""), F.lit(0))
    return F.forall(kept, lambda t: F.contains(after, t))


OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, OUTER, ""))


def split_name(c: Column) -> Column:
    """The split meant, however spelled: outer blanks and case mean nothing, dev and validation are val."""
    s = trimmed_lower(c)
    return F.when(s.isin("dev", "validation"), "val").otherwise(s)


def _rendered(value: object, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(value, dict):
        return "\n".join(f"{pad}{k}: {_below(v, depth)}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{pad}- {_below(v, depth + 1)}" for v in value)
    return str(value)


def _below(value: object, depth: int) -> str:
    """A value after its key: text with its own lines indented, an object or list from the next line on."""
    if isinstance(value, (dict, list)):
        return "\n" + _rendered(value, depth + 1) if value else ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.replace("\n", "\n" + "  " * (depth + 1))


def _render(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _rendered(json.loads(t)))


def render_state(c: Column) -> Column:
    """JSON objects as indented lines, of any depth; other texts never leave the JVM."""
    return F.when(F.json_object_keys(c).isNotNull(), F.pandas_udf(_render, "string")(F.when(F.json_object_keys(c).isNotNull(), c))).otherwise(c)


TOKENS = "[\\p{L}\\p{N}]{1,6}|[^\\p{L}\\p{N}\\s]"


def fitting_heads(words_: Column, question: Column, options: Column, limit: int) -> Column:
    """For each option how many of the question's words may stand before it so that head, one mark and option have at most
    limit tokens; all of them where the whole question fits."""
    size = lambda c: F.regexp_count(c, F.lit(TOKENS))
    heads = lambda w: F.transform(F.sequence(F.lit(0), F.size(w)), lambda k: size(F.array_join(F.slice(w, F.lit(1), k), " ")))
    fit = lambda w, h, q: F.transform(options, lambda o: F.when(q + size(o) + 1 <= limit, F.size(w)).otherwise(F.greatest(F.lit(0), F.size(F.filter(h, lambda x: x + size(o) + 1 <= limit)) - 1)).cast("bigint"))
    return let(words_, lambda w: let(heads(w), lambda h: let(size(question), lambda q: fit(w, h, q))))


def judged_parts(state: Column, shorter_than: int = 400) -> Column:
    """What a state asks about: the named members of a JSON object, or a short plain text itself."""
    named = F.array_compact(F.array(*[F.get_json_object(state, f"$.{k}") for k in ("command", "goal", "proposed", "task", "input.command")]))
    return F.when(F.json_object_keys(state).isNotNull(), named).when(F.length(state) < shorter_than, F.array(state)).otherwise(F.array().cast("array<string>"))


def reversed_mark(c: Column) -> Column:
    return F.concat(F.lit("⟦rev:"), F.reverse(c), F.lit("⟧"))


def unreversed(c: Column) -> Column:
    """The text with every marked stretch turned round and the marks gone."""
    parts = F.regexp_extract_all(c, F.lit("(?s)⟦rev:[^⟧]*⟧|.[^⟦]*"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("⟦rev:") & p.endswith("⟧"), F.reverse(F.substring(p, F.lit(6), F.length(p) - 6))).otherwise(p)), "")


def stands_alone(c: Column, name: Column) -> Column:
    """Whether the name occurs with neither a letter, digit, underscore nor hyphen beside it."""
    return F.regexp_like(F.concat(F.lit(" "), c, F.lit(" ")), F.concat(F.lit("[^\\w-]\\Q"), name, F.lit("\\E[^\\w-]")))


def worded_options(options: Column, key: Column) -> Column:
    """Options in one of five wordings, drawn by a hash of key; the pretty one where two come out alike."""
    named = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    described = lambda c: F.concat(named(c), F.lit(": "), pretty_label(c))
    bit = lambda i: _hex8(F.md5(F.concat(key, F.lit(":"), i.cast("string")))) % 2
    u = md5_bucket("style", key)
    pretty = F.transform(options, pretty_label)
    mixed = F.transform(options, lambda c, i: F.when(bit(i) == 0, named(c)).otherwise(described(c)))
    made = F.when(u < 0.33, pretty).when(u < 0.48, F.transform(options, named)).when(u < 0.56, F.transform(options, lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30)))).when(u < 0.76, F.transform(options, described)).otherwise(mixed)
    return let(made, lambda o: F.when(F.size(F.array_distinct(o)) < F.size(o), pretty).otherwise(o))
