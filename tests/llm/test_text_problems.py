"""The operators on training text: brute force on small tables, and every odd case."""

import json
import os
import random
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import textkernel as tk
from sievework.llm import bpe, langid, leakage, lookalikes, mixing, queries, shared_spans

SF = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path()
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
vocabulary = pytest.mark.skipif(not os.path.isfile(PATH), reason="no tokenizer")


# 1: leaked evaluation texts


def words(rng, n, vocab=40):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def test_leaked_against_brute_force(spark):
    rng = random.Random(2)
    items, docs = [], []
    for i in range(30):
        items.append((f"i{i}", " ".join(words(rng, rng.choice([3, 16, 17, 40]))), None if i % 3 else " ".join(words(rng, 18)), "x"))
    for i in range(60):
        own = words(rng, rng.choice([0, 10, 60]))
        if i % 2:
            src = (items[i % 30][1] if i % 4 == 1 else items[i % 30][2] or "").split()
            at = rng.randrange(max(1, len(src) - 15))
            own += src[at : at + rng.choice([15, 16, 16, 20])] + words(rng, 5)
        docs.append((i, ", ".join(own).upper() if i % 5 == 0 else " ".join(own), "x", "y"))
    docs += [(100, None, "", ""), (101, "", "", ""), (102, "… !", "", ""), (103, " ".join(["same"] * 500), "", ""), (None, docs[1][1], "", "")]
    items += [("rep", " ".join(["same"] * 40), None, "x"), ("none", None, None, "x"), (None, items[0][1], None, "x"), items[0]]
    docs.append((104, docs[1][1] + " pad" * 60_000, "", ""))
    docs.append(docs[1])
    got = leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string, id string, key string"), spark.createDataFrame(items, "id string, state string, question string, text string"), ["state", "question"])
    got = {tuple(r) for r in got.collect()}
    want = set()
    for d, t, *_ in docs:
        for i, s, q, _ in items:
            for field, x in (("state", s), ("question", q)):
                if d is not None and i is not None and t and x:
                    a, b = tk.word_list(t), tk.word_list(x)
                    if {tuple(a[j : j + 16]) for j in range(len(a) - 15)} & {tuple(b[j : j + 16]) for j in range(len(b) - 15)}:
                        want.add((d, i, field))
    assert got == want and len(want) > 10


def test_short_fields_are_sought_whole(spark):
    items = [("a", "one two three four"), ("b", "two three"), ("c", "four five six seven eight"), ("d", " ".join(f"w{i}" for i in range(20)))]
    docs = [(1, "Zero ONE two, three: four five six seven"), (2, "one two three"), (3, "x four five six seven eight"), (4, " ".join(f"w{i}" for i in range(2, 18))), (5, None), (6, "one two four three")]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "id string, state string")
    got = {tuple(r) for r in leakage.leaked(d, e, ["state"], least=3).collect()}
    assert got == {(1, "a", "state"), (3, "c", "state"), (4, "d", "state")}
    assert {tuple(r) for r in leakage.leaked(d, e, ["state"]).collect()} == {(4, "d", "state")}
    with pytest.raises(ValueError):
        leakage.leaked(d, e, ["state"], least=2)


def test_room_is_a_bound_only(spark):
    cases = [([0], 16, [0], 16, True), ([0], 15, [0], 16, False), ([10], 40, [2], 17, True), ([10], 12, [2], 40, False), ([3, 30], 40, [0], 16, True), ([0], 5, [0], 5, True)]
    df = spark.createDataFrame([c[:4] for c in cases], "d array<int>, n int, e array<int>, m int")
    got = [r["r"] for r in df.select(leakage.room(F.col("d"), F.col("n"), F.col("e"), F.col("m"), 16).alias("r")).collect()]
    assert got == [c[4] for c in cases]


def test_leaked_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "id string, state string")
    assert leakage.leaked(d, i, ["state"]).collect() == []


# 2: languages

PHRASES = {
    "en": "the reviewer has asked for a copy of the signed form and is still waiting for an answer",
    "de": "die Prüferin hat eine Kopie des unterschriebenen Formulars verlangt und wartet noch immer auf eine Antwort",
    "fr": "la relectrice a demandé une copie du formulaire signé et attend toujours une réponse de notre équipe",
    "es": "la revisora ha pedido una copia del formulario firmado y todavía espera una respuesta de nuestro equipo",
    "ru": "проверяющая просит копию подписанной формы и всё ещё ждёт ответа от нашей службы",
    "tr": "denetçi imzalı formun bir kopyasını istedi ve hâlâ ekibimizden bir yanıt bekliyor",
    "fa": "بازبین رونوشت فرم امضا شده را خواست و هنوز منتظر پاسخ گروه ما است و باید آن را ببیند",
    "ar": "طلبت المراجعة نسخة من النموذج الموقع ولا تزال تنتظر الجواب من فريقنا في هذه المدينة",
}
CHOICES = {"en": ["yes", "no"], "de": ["ja", "nein"], "fr": ["oui", "non"], "es": ["sí", "no"], "ru": ["да", "нет"], "tr": ["evet", "hayır"], "fa": ["بله", "خیر"], "ar": ["نعم", "لا"]}


def language_rows(rng):
    rows = []
    for k in range(25):
        for lang, p in PHRASES.items():
            w = p.split()
            rng.shuffle(w)
            rows.append((len(rows), " ".join(w) + f" {rng.randrange(10**6)}.", CHOICES[lang], lang if k else "??", lang))
    return rows


def test_languages(spark):
    rng = random.Random(1)
    rows = language_rows(rng)
    n = len(rows)
    rows += [
        (n, f"{PHRASES['en']}. {PHRASES['de']}.", ["yes", "no"], "en", "de"),
        (n + 1, '{"tool_result": "%s", "channel": "voice"}' % PHRASES["ru"], ["s​í", "no"], "en-US", None),
        (n + 2, f"{PHRASES['en']} “savoir vivre” by Tanetrog Reminunard.", ["ＹＥＳ", "no"], "EN_us", "EN"),
        (n + 3, None, None, "en", "en"),
        (n + 4, " \n", [], "en", "en"),
        (n + 5, "12345 #99", ["1", None], "en", "en"),
        (n + 6, "\n".join([PHRASES["fr"] + "."] * 2000), ["oui", "non"], "fr", "fr"),
        (n + 7, '{"a": "' + PHRASES["tr"], ["evet", "hayır"], "tr", "tr"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, state string, choices array<string>, state_lang string, choice_lang string, lang string")
    got = {}
    for r in langid.detect_languages(df, "row_id").collect():
        assert 0 < r["confidence"] <= 1
        got.setdefault((r["id"], r["field_name"]), {})[r["lang"]] = r["fits"]
    for i, _, _, sl, cl in rows[:n]:
        assert got[i, "state"] == {cl: sl == cl} and got[i, "choices"] == {cl: True}
    assert set(got[n, "state"]) == {"en", "de"} and got[n, "choices"] == {"en": False}
    assert got[n + 1, "state"] == {"ru": False} and got[n + 1, "choices"] == {"es": False}
    assert got[n + 2, "state"] == {"en": True} and got[n + 2, "choices"] == {"en": True}
    assert not any((n + k, f) in got for k in (3, 4, 5) for f in ("state", "choices"))
    assert got[n + 6, "state"] == {"fr": True} and got[n + 7, "state"] == {"tr": True}
    assert langid.detect_languages(df.limit(0), "row_id").collect() == []


def test_segments_of_mixed_states(spark):
    rows = language_rows(random.Random(1))
    n = len(rows)
    en, de, ru = PHRASES["en"], PHRASES["de"], PHRASES["ru"]
    rows += [
        (n, f"{en}. Right. {de}. {de}. {en}.", ["yes"], "en", "en"),
        (n + 1, json.dumps({"a": f"{ru}. {en}.", "b": en + "."}, ensure_ascii=False), ["yes"], "en", "en"),
        (n + 2, f"{en}. {en}.", ["yes"], "en", "en"), (n + 3, None, None, None, None), (n + 4, "", [], "en", "en"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, state string, choices array<string>, state_lang string, choice_lang string, lang string")
    got = sorted((r["id"], r["text"], r["segment"], r["lang"], r["content"]) for r in langid.segment_languages(df, "row_id").collect() if r["id"] >= n)
    assert got == [(n, 0, 0, "en", f"{en}. Right."), (n, 0, 1, "de", f"{de}. {de}."), (n, 0, 2, "en", f"{en}."), (n + 1, 0, 0, "ru", f"{ru}."), (n + 1, 0, 1, "en", f"{en}."), (n + 1, 1, 0, "en", f"{en}.")]
    assert all(0.3 < r["confidence"] <= 1 and r["letters"] > 20 for r in langid.segment_languages(df, "row_id").collect())
    assert langid.segment_languages(df.limit(0), "row_id").collect() == []


def test_short_sentences_in_another_script(spark):
    rows = language_rows(random.Random(8))
    n = len(rows)
    cases = [(f"{PHRASES['fa']}. C'est tout. {PHRASES['fa']}.", True), (f"{PHRASES['en']}. Да, так! {PHRASES['en']}.", True), (f"{PHRASES['fa']}. Tanetrog {PHRASES['fa']}.", False), (f"{PHRASES['ru']}. OK. {PHRASES['ru']}.", False)]
    rows += [(n + i, t, ["yes", "no"], None, None) for i, (t, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "row_id long, state string, choices array<string>, state_lang string, choice_lang string")
    got = {}
    for r in langid.detect_languages(df, "row_id").where("field_name = 'state'").collect():
        got.setdefault(r["id"], set()).add(r["lang"])
    assert [len(got[n + i]) > 1 for i in range(len(cases))] == [two for _, two in cases]
    assert got[n + 1] == {"en", "ru"} and "fa" in got[n]
    assert all(got[r[0]] == {r[4]} for r in rows[:n])


@pytest.mark.parametrize("missing", ["state_lang", "choice_lang"])
def test_languages_with_labels_of_one_field(spark, missing):
    rows = [r for r in language_rows(random.Random(3)) if r[3] != "??"]
    df = spark.createDataFrame(rows, "row_id long, state string, choices array<string>, state_lang string, choice_lang string")
    got = {}
    for r in langid.detect_languages(df.withColumn(missing, F.lit(None).cast("string")), "row_id").collect():
        got.setdefault((r["id"], r["field_name"]), {})[r["lang"]] = r["fits"]
    field, labelled = ("state", "choices") if missing == "state_lang" else ("choices", "state")
    assert all(got[r[0], labelled] == {r[4]: True} for r in rows)
    assert all((r[0], field) in got and not any(got[r[0], field].values()) for r in rows)


def test_held_out_accuracy():
    rng = random.Random(4)
    rows = language_rows(rng)
    texts, labels = [r[1] for r in rows], np.array([langid.LANGUAGES.index(r[4]) for r in rows])
    held = np.arange(len(rows)) // 8 % 2 == 0
    model = langid.Model(2048).fit(pa.array([t for t, h in zip(texts, held) if not h]), labels[~held])
    cps, offs = tk.codepoints(langid.normal(pa.array([t for t, h in zip(texts, held) if h])))
    cosines, _ = model.score(cps, offs, offs[:-1])
    assert (cosines.argmax(1) == labels[held]).all()


# 4: look-alikes


def test_lookalikes(spark):
    rng = random.Random(6)
    fa, ar = PHRASES["fa"], PHRASES["ar"]
    rows = [(i, s, c, sl, cl) for i, s, c, sl, cl in language_rows(rng)]
    n = len(rows)
    cases = [
        ("plain text with “quotes” – and … dots, tab\tand\r\nlines", None), ("ｗide", "compatibility"), ("café", "mark"), ("x́q", "x́q" != unicodedata.normalize("NFC", "x́q") and "mark"), ("zero​width", "invisible"),
        ("no break", "blank"), ("сору of paper", None), ("cоpy of the form", "mixed_script"), ("paper and бумага together ✅ ⚡", None), ("", None), (None, None), (fa, None), (ar, None),
        (fa.replace("ی", "ي", 1), "yeh_kaf"), (ar.replace("ي", "ی", 1), "yeh_kaf"), ("x" * 100_000 + " ", "blank"), ("été naïve straße İstanbul", None), ("word ﬁn", "compatibility"),
    ]
    rows += [(n + i, t, None if t is None else [t, None, "ok"], "xx", "xx") for i, (t, _) in enumerate(cases)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "row_id long, state string, choices array<string>, state_lang string, choice_lang string, id string, kinds string")
    fields = {"state": "state_lang", "choices": "choice_lang"}
    got = {(r["id"], r["field_name"]): r["kinds"] for r in lookalikes.find_lookalikes(df, "row_id", fields).collect()}
    assert not any(i < n for i, _ in got)
    for i, (t, kind) in enumerate(cases):
        for f in ("state", "choices"):
            assert got.get((n + i, f), 0) == (lookalikes.KINDS[kind] if kind else 0), (t and t[:40], f)
    fixed = {(r["id"], r["field_name"]): r["text"] for r in lookalikes.repair_lookalikes(df, "row_id", fields).collect()}
    assert set(fixed) == set(got)
    at = {t: n + i for i, (t, _) in enumerate(cases)}
    assert fixed[at["ｗide"], "state"] == "wide" and fixed[at["café"], "state"] == "café" and fixed[at["zero​width"], "state"] == "zerowidth"
    assert fixed[at["no break"], "choices"] == '["no break", null, "ok"]'
    assert fixed[at["cоpy of the form"], "state"] == "copy of the form"  # `copy` stands in other rows
    assert fixed[at[fa.replace("ی", "ي", 1)], "state"] == fa and fixed[at[ar.replace("ي", "ی", 1)], "state"] == ar
    assert lookalikes.find_lookalikes(df.limit(0), "row_id", fields).collect() == [] == lookalikes.repair_lookalikes(df.limit(0), "row_id", fields).collect()


def test_short_sentences_go_with_what_they_close(spark):
    rows = [(i, s, c, sl, cl) for i, s, c, sl, cl in language_rows(random.Random(6))]
    n, fa, ar = len(rows), PHRASES["fa"], PHRASES["ar"]
    cases = [f"{fa}. پاسخی نیامد. {ar}.", f"{ar}. لم يرد أحد. {fa}.", f"{fa}.\nفي\n{ar}.", f"{fa}. پاسخي نيامد. {ar}."]
    rows += [(n + i, t, None, "xx", "xx") for i, t in enumerate(cases)]
    df = spark.createDataFrame(rows, "row_id long, state string, choices array<string>, state_lang string, choice_lang string")
    got = {r["id"] - n for r in lookalikes.find_lookalikes(df, "row_id", {"state": "state_lang"}).collect()}
    assert got == {3}


def test_substitutes():
    assert lookalikes.substitutes("cору") == ["сору", "copy"] and lookalikes.substitutes("cоpy") == ["copy", "сору"]
    assert lookalikes.substitutes("haηdled") == ["handled"] and lookalikes.substitutes("дaтa") == ["дата"]
    assert lookalikes.substitutes("gжz") == []


def test_repair_of_words_with_two_disguises(spark):
    cases = {
        "pay\u200bp\u0430l": "paypal", "payp\u200b\u0430\u200bl": "paypal", "\uff50ayp\u0430l": "paypal", "\u0441afe\u0301": "caf\u00e9", "caf\u0435\u0301": "caf\u00e9", "r\u0435\u0301sum\u0435\u0301.": "r\u00e9sum\u00e9.",
        "p\u0430yp\u0430l and c\u0430f\u00e9": "paypal and caf\u00e9", "p\u0430ypal\u0303": "paypal\u0303", "zz\u0430\u200bz": "zz\u0430z",
    }
    rows = [(i, t, [t, None], "en") for i, t in enumerate(cases)] + [(99, "Paypal café résumé", ["ok"], "en")]
    df = spark.createDataFrame(rows, "row_id long, state string, choices array<string>, lang string")
    got = {(r["id"], r["field_name"]): r["text"] for r in lookalikes.repair_lookalikes(df, "row_id", {"state": "lang", "choices": None}).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i, "state"] == want and got[i, "choices"] == f'["{want}", null]', i
    assert len(got) == 2 * len(cases)


def test_repair_of_repeated_and_nameless_rows(spark):
    rows = [(1, "a\u200bb", ["x\u00a0y", None], "p"), (1, "a\u200bb", ["x\u00a0y", None], "q"), (None, "c\u200bd", None, "p"), (2, None, [], "p"), (3, "", None, "p")]
    df = spark.createDataFrame(rows, "row_id long, state string, choices array<string>, id string").withColumns({c: F.lit("x") for c in ("text", "kinds", "field_name", "words")})
    got = sorted((r["id"], r["field_name"], r["text"]) for r in lookalikes.repair_lookalikes(df, "row_id", {"state": None, "choices": None}).collect())
    assert got == [(1, "choices", '["x y", null]'), (1, "state", "ab")]


def test_parted_words_and_joined_emoji(spark):
    cases = {"می\u200cروم": "میروم", "کار\u200cنامه": "کار نامه", "ناپ\u200cقغ": "ناپقغ", "👩\u200d💻 ok": "👩\u200d💻 ok", "a\u200db": "ab"}
    rows = [(i, t, "en") for i, t in enumerate(cases)] + [(99, "میروم کار نامه", "en")]
    df = spark.createDataFrame(rows, "row_id long, state string, lang string")
    got = {r["id"]: r for r in lookalikes.repair_lookalikes(df, "row_id", {"state": None}).collect()}
    for i, (t, want) in enumerate(cases.items()):
        assert (got[i]["text"] if i in got else t) == want, t
    assert 3 not in got and all(r["changed"] and r["unsolved"] == [] for r in got.values())


def test_planted_defects_are_undone(spark):
    """Clean sentences with one defect each come back as they were, and clean ones are not named."""
    rng = random.Random(16)
    clean = ["please send the signed copy of the café paper", "Мы отправили заказ в отдел проверки", "la réponse traduite est déjà arrivée", "die Prüfung der Lieferung ist möglich"]
    wide = lambda c: chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c
    latin = lookalikes.LATIN_OF
    cyrillic = {a: b for a, b in lookalikes.CYRILLIC_OF.items() if latin.get(b) == a}

    def spoil(t):
        at = [i for i, c in enumerate(t) if c.isalpha()]
        i = rng.choice(at)
        kind = rng.randrange(5)
        if kind == 0:
            return t[:i] + wide(t[i]) + t[i + 1 :]
        if kind == 1:
            return t[:i] + rng.choice("\u200b\u2060\ufeff\u00ad") + t[i:]
        if kind == 2:
            return t.replace(" ", rng.choice("\u00a0\u2009\u3000"), 1)
        if kind == 3:
            return unicodedata.normalize("NFD", t)
        near = [j for j in at if len(next(w for w in t.split() if t[j] in w)) > 3 and (latin.get(t[j]) or cyrillic.get(t[j])) and (t[j - 1 : j].isalpha() or t[j + 1 : j + 2].isalpha())]
        j = rng.choice(near)
        return t[:j] + (latin.get(t[j]) or cyrillic[t[j]]) + t[j + 1 :]

    rows = [(i, clean[i % 4]) for i in range(8)]
    spoilt = [(100 + i, clean[i % 4]) for i in range(200)]
    df = spark.createDataFrame(rows + [(i, spoil(t)) for i, t in spoilt], "row_id long, state string")
    changed = {r["row_id"]: r["state"] for r in df.collect()}
    got = {r["id"]: r["text"] for r in lookalikes.repair_lookalikes(df, "row_id", {"state": None}).where("changed").collect()}
    for i, t in spoilt:
        assert got.get(i, changed[i]) == t, (changed[i], got.get(i))
    assert not any(i < 100 for i in got)


# 7: tokens


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_vocabulary(PATH))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@vocabulary
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aets' \n\t1l.<|>é😀", max_size=60)), max_size=5))
def test_ids_are_those_of_the_library(encoder, reference, texts):
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    want = [reference.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@vocabulary
def test_encode_table(spark, reference):
    rows = [(1, None, "a"), (2, "", "b"), (3, "<|endoftext|> it's", "c"), (4, "na" * 60_000 + " 12" * 1000, "d"), (4, "x", None), (None, "  x", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in bpe.encode(df, PATH).collect())
    want = sorted((i or 0, reference.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows)
    assert got == want
    assert bpe.encode(df.limit(0), PATH).collect() == []
    clash = bpe.encode(df.withColumnRenamed("ids", "body").withColumnRenamed("text", "x").withColumnRenamed("body", "text"), PATH, text="x", lists=False)
    assert clash.columns == ["doc_id", "text", "n_tokens"] and clash.where("doc_id = 1").first()["n_tokens"] == 0


# 8: mixing


def test_distribute_prefers_siblings():
    root = mixing.Node(1)
    for source, w, leaves in (("a", 0.5, {"x": 10, "y": 100}), ("b", 0.5, {"x": 1000})):
        for lang, cap in leaves.items():
            root.child(source, w).child(lang, 1.0).own = cap
    got = mixing.distribute(root, 160)
    assert got == {("a", "x"): 10, ("a", "y"): 70, ("b", "x"): 80}
    got = mixing.distribute(root, 400)
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}
    assert abs(sum(mixing.distribute(root, 9999).values()) - 1110) < 1e-6


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "z", None]), rng.choice(["en", "de", None]), rng.choice([0, 3, 5, 9])) for i in range(3000)]
    rows += [(10_000 + i, "tiny", "en", 4) for i in range(5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.2, 3), ("none", 0.05, 2), ("tiny", 0.05, 6)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix_sources(sizes, targets)
    s = {r["source"]: r for r in shares.collect()}
    assert s["none"]["share"] == 0 and s["tiny"]["mixed_tokens"] == 5 * 4 * 6
    for k, t in (("a", 0.5), ("b", 0.2), ("c", 0.2), ("tiny", 0.05)):
        assert abs(s[k]["share"] - t / 0.95) < 0.01, s
    uses = chosen.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("e")).collect()
    assert all(r["n"] == r["e"] and r["n"] <= {"a": 1, "b": 2, "c": 3, "tiny": 6}[r["source"]] for r in uses)
    spread = {}
    for r in uses:
        spread.setdefault(r["source"], set()).add(r["n"])
    assert spread["tiny"] == {6}
    # all tokens of the targets' sources: tiny is short, and what it lacks goes to the others by their targets
    full, shares = mixing.mix_sources(sizes, targets, "available")
    s = {r["source"]: r for r in shares.collect()}
    total = sum(n for _, x, _, n in rows if x in ("a", "b", "c", "tiny"))
    assert abs(sum(r["mixed_tokens"] for r in s.values()) - total) < 40 and s["tiny"]["mixed_tokens"] == 5 * 4 * 6 and s["a"]["mixed_tokens"] <= s["a"]["available_tokens"]
    room = {k: s[k]["available_tokens"] * s[k]["max_repeats"] - s[k]["mixed_tokens"] for k in ("a", "b", "c")}
    free = [k for k in room if room[k] > 20]
    assert len(free) >= 2 and max(s[k]["share"] / s[k]["target_share"] for k in free) - min(s[k]["share"] / s[k]["target_share"] for k in free) < 0.03
    with pytest.raises(ValueError):
        mixing.mix_sources(sizes, targets, max_leaves=3)
    by_domain, _ = mixing.mix_sources(sizes.withColumn("domain", F.when(F.col("doc_id") % 2 == 0, "x")), targets)
    assert abs(by_domain.agg(F.sum("n_tokens")).first()[0] - chosen.agg(F.sum("n_tokens")).first()[0]) < 60
    big, _ = mixing.mix_sources(sizes, targets, total_tokens=10**9)
    assert big.agg(F.sum("n_tokens")).first()[0] == sum(n * {"a": 1, "b": 2, "c": 3, "tiny": 6}.get(x, 0) for _, x, _, n in rows)
    again, _ = mixing.mix_sources(sizes.repartition(7), targets)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, chosen.collect()), key=str)
    none, report = mixing.mix_sources(sizes.limit(0), targets)
    assert none.count() == 0 and report.count() == 5


# 9: shared spans


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh  ") for _ in range(n))
    passages = [text(n) for n in (60, 45, 41, 40, 39)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), text(rng.randrange(60))]
        rows.append((i, "".join(parts), "x"))
    rows += [(100, None, "x"), (101, "", "x"), (102, "short", "x"), (103, "=" * 5000, "x"), (104, "." + "=" * 4000 + "?", "x"), (105, rows[3][1], "x"), (106, rows[3][1], "x"), (None, rows[3][1], "x"), rows[3]]
    rows += [(107, "é😀" * 3000 + passages[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    pairs, classes = shared_spans.shared_spans(df, span=40, k=25)
    got = {tuple(r) for r in shared_spans.sharing_pairs(pairs, classes).collect()}
    own = {i: t for i, t, _ in rows if i is not None and t}
    grams = {i: {t[j : j + 40] for j in range(len(t) - 39)} for i, t in own.items()}
    want = {(a, b) for a in own for b in own if a < b and grams[a] & grams[b]}
    assert got == want and len(want) > 30
    shared = {r["id"]: (r["n_chars"], r["shared_chars"]) for r in shared_spans.shared_share(df, pairs, classes).where("id IS NOT NULL").collect()}
    for i, t in own.items():
        covered = set()
        for j in range(len(t) - 39):
            if any(t[j : j + 40] in grams[o] for o in own if o != i):
                covered |= set(range(j, j + 40))
        assert shared[i] == (len(t), len(covered)), i
    assert shared[100] == (0, 0) and shared[102] == (5, 0)
    pairs, classes = shared_spans.shared_spans(df.limit(0))
    assert shared_spans.sharing_pairs(pairs, classes).collect() == [] == shared_spans.shared_share(df.limit(0), pairs, classes).collect()


def test_chain():
    anchors = [(0, 100), (10, 110), (20, 120), (30, 5), (500, 600), (510, 610)]
    chains = shared_spans.chain(anchors, 8)
    assert [(0, 100), (10, 110), (20, 120)] in chains and [(500, 600), (510, 610)] in chains and [(30, 5)] in chains


@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
@settings(max_examples=200, deadline=None)
def test_edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (c != d))
    assert shared_spans.edits(x, y) == row[-1]


def test_passages_join_runs_over_a_gap(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b = text(60), text(70)
    df = spark.createDataFrame([(1, text(30) + a + "XX" + b), (2, a + "YYY" + b + text(20))], "doc_id long, text string")
    pairs, _ = shared_spans.shared_spans(df, span=50, k=30)
    r = pairs.first()
    assert [x["n"] for x in r["runs"]] == [60, 70]
    assert len(r["passages"]) == 1 and r["passages"][0]["exact"] == 130 and r["passages"][0]["a_end"] - r["passages"][0]["a"] == 132


def test_repeats_count_on_both_sides(spark):
    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    block = text(250)
    rows = [(1, "-" * 300), (2, "-" * 5000), *((i, "".join(text(rng.randrange(20, 90)) + block for _ in range(n)) + text(30)) for i, n in ((3, 45), (4, 60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, classes = shared_spans.shared_spans(df)
    own = dict(rows)
    for r in pairs.collect():
        a, b = own[r["id_a"]], own[r["id_b"]]
        for i, j, n in r["runs"]:
            assert a[i : i + n] == b[j : j + n] and n >= 200
            assert (i == 0 or j == 0 or a[i - 1] != b[j - 1]) and (i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n])
        if r["id_a"] == 3:
            assert all(any(p["b"] <= x < p["b_end"] for p in r["passages"]) for x in range(len(b)) if b.find(block, max(0, x - 249), x + 250) >= 0)
    shared = {r["id"]: r["shared_chars"] for r in shared_spans.shared_share(df, pairs, classes).collect()}
    grams = {i: {t[j : j + 200] for j in range(len(t) - 199)} for i, t in rows}
    for i, t in rows:
        covered = set()
        for j in range(len(t) - 199):
            if any(t[j : j + 200] in grams[o] for o in own if o != i):
                covered |= set(range(j, j + 200))
        assert shared[i] == len(covered), i


def test_both_ways_of_comparing_cover_the_same(monkeypatch):
    """Whether a pair has few or very many equal seeds, the same characters of both texts are shared."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    rarity = np.zeros(1 << 18, np.int32)
    span, k = 40, 22
    for trial in range(40):
        block, other = text(rng.choice([41, 60, 90])), "".join(rng.choice("xy") for _ in range(3)) * 30
        make = lambda: "".join(rng.choice([block, other, text(rng.randrange(1, 50)), block[:45]]) for _ in range(rng.randrange(2, 9)))
        a, b = make(), make()
        if min(len(a), len(b)) < span or a == b:
            continue
        batch = pa.record_batch([pa.array([0, 1]), pa.array([a, b])], ["id", "text"])
        found = [r for out in shared_spans._seeds(k, span, rarity)(iter([batch])) for r in out.to_pylist()]
        places = [{r["seed"]: r["more"] or [r["at"]] for r in found if r["id"] == i} for i in (0, 1)]
        seeds = [(places[0][x], places[1][x]) for x in places[0] if x in places[1]]
        covered = []
        for many, per_place in ((10**9, 10**9), (-1, -1)):
            monkeypatch.setattr(shared_spans, "MANY", many)
            monkeypatch.setattr(shared_spans, "PER_PLACE", per_place)
            runs, passages = shared_spans.compare(a, b, seeds, k, span) if seeds else ([], [])
            covered.append([{x for r in runs for x in range(r[side], r[side] + r[2])} for side in (0, 1)])
            assert all(shared_spans.edits(a[p["a"] : p["a_end"]], b[p["b"] : p["b_end"]]) <= p["edits"] for p in passages)
        assert covered[0] == covered[1], trial
        for side, (x, y) in enumerate(((a, b), (b, a))):
            want = {j for i in range(len(x) - span + 1) if x[i : i + span] in y for j in range(i, i + span)}
            assert covered[0][side] == want, (trial, side)


def test_passages_of_pairs_with_many_seeds(spark):
    rng = random.Random(16)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    edited = lambda t, step: "".join(t[i : i + step - 1] + "X" for i in range(0, len(t), step))
    long, short = text(60_000), text(2000)
    cases = [(long, edited(long, 400)), (short + "=" * 3000, edited(short, 39) + "=" * 2500)]
    for a, b in cases:
        pairs, _ = shared_spans.shared_spans(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), span=40, k=20)
        passages = pairs.first()["passages"]
        best = max(passages, key=lambda p: min(p["a_end"], len(a.rstrip("="))) - p["a"])
        assert min(best["a_end"], len(a.rstrip("="))) - best["a"] > 0.9 * len(a.rstrip("="))


# all queries


@tables
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_same_rows_whatever_the_partitions(spark, name):
    """Queries without SQL give rows, and the very same ones when the work is cut up otherwise."""

    def rows():
        df = queries.QUERIES[name](spark, SF)
        return sorted(map(repr, df.select(sorted(df.columns)).collect()))

    first = rows()
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, ("7", "65536", "37"), strict=True):
            spark.conf.set(k, v)
        again = rows()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert first and first == again


@tables
@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "items", "examples"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.SQL[name])
    found = con.sql(f"SELECT {', '.join(sorted(want.columns))} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=repr) == sorted(found, key=repr)


@tables
@vocabulary
def test_mix_query_keeps_caps_and_sums(spark):
    """Sums over what is chosen are those reported; no document is used more often than its source may be; whole epochs come first."""
    chosen, shares = queries._mix(spark, SF)
    uses = chosen.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last"), F.countDistinct("epoch").alias("epochs"), F.sum("n_tokens").alias("t")).toPandas()
    report = {r["source"]: r for r in shares.collect()}
    assert (uses.n == uses.epochs).all() and (uses.n == uses["last"]).all()
    for source, part in uses.groupby("source"):
        r = report[source]
        assert part.n.max() <= r["max_repeats"] and part.t.sum() == r["mixed_tokens"] and part.n.max() - (part.n.min() if len(part) == r["n_documents"] else 0) <= 1
    total = sum(r["mixed_tokens"] for r in report.values())
    assert all(abs(r["share"] - r["mixed_tokens"] / total) < 1e-6 for r in report.values())
    short = [r for r in report.values() if r["n_documents"] and r["share"] < 0.9 * r["target_share"]]
    assert short and all(r["mixed_tokens"] >= 0.9 * r["available_tokens"] * r["max_repeats"] for r in short)


@tables
def test_passages_are_aligned_chains(spark):
    """Each passage's two stretches differ by no more edits than it tells, and its ends are equal stretches."""
    rapidly = shared_spans.edits
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    rows = queries.p9_passages(spark, SF).collect()
    assert rows
    for r in rows:
        a, b = text[r["doc_id_a"]][r["a"] : r["a_end"]], text[r["doc_id_b"]][r["b"] : r["b_end"]]
        assert rapidly(a, b) <= r["edits"] and a[:20] == b[:20] and a[-20:] == b[-20:] and r["exact"] <= min(len(a), len(b))
