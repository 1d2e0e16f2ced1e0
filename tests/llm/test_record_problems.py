"""Layout duplicates, group splits and overlap across splits on small tables with every odd case."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import record_dups
from sievework.llm.group_split import allocate, place_heavy, split_groups, split_shares
from sievework.llm.record_dups import layout_duplicates, record_counts, same_records
from sievework.llm.split_overlap import Shard, overlap_pairs, overlap_report, split_overlap

SCHEMA = "row_id long, state string, question string, choices array<string>, split string, id string, key string, rep string"
RECORDS = [
    (1, "Hello,  World", "Is it?", ["Yes", "no"], "train"),
    (2, "hello world!", "IS IT", ["NO.", "yes"], "train"),
    (3, "hello worlds", "is it", ["no", "yes"], "train"),
    (4, '{"a": "X y", "b": [1, 2]}', "q", ["a"], "train"),
    (5, '{"B": [1,2], "a": "xy"}', "q", ["a"], "train"),
    (6, '{"a": "x", "yb": [1,2]}', "q", ["a"], "train"),
    (7, '{"a": "X y", "b": [1', "q", ["a"], "train"),
    (8, '{ "a": "xy", "b": [1', "q", ["a"], None),
    (9, None, "q", ["a"], "train"),
    (10, "  \n", "q", ["a"], "train"),
    (11, "t", None, None, "train"),
    (12, "T", None, None, "train"),
    (13, "t", "", [], "train"),
    (14, "t", None, [None], "train"),
    (15, "x" * 200_000 + "İ", "q", ["a"], "train"),
    (16, "X" * 200_000 + "i", "q", ["a"], "train"),
    (16, "X" * 200_000 + "i", "q", ["a"], "train"),
    (None, "t", None, None, "train"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 3) for r in rows], SCHEMA)


def test_layout_duplicates(spark):
    df = table(spark, RECORDS)
    got = sorted(map(tuple, layout_duplicates(df, "row_id").collect()))
    assert got == [(1, 2), (4, 5), (7, 8), (11, 12), (15, 16)]
    counts = {r["rep"]: r["copies"] for r in record_counts(df, "row_id").collect()}
    assert counts[1] == 2 and counts[3] == 1 and 9 not in counts
    assert layout_duplicates(df.limit(0), "row_id").collect() == []


def test_equal_keys_of_different_records(spark, monkeypatch):
    """With one key for all records every pair is decided by comparison, round after round."""

    def one_key(batches):
        for b in batches:
            yield pa.record_batch([b.column("id"), pa.array([0] * b.num_rows, pa.int64())], ["id", "key"])

    monkeypatch.setattr(record_dups, "_keys", one_key)
    df = table(spark, RECORDS[:15])
    assert sorted(map(tuple, layout_duplicates(df, "row_id").collect())) == [(1, 2), (4, 5), (7, 8), (11, 12)]


@pytest.mark.parametrize("stride", [1, 3, 1024])
def test_pointers_skip_and_stop(stride):
    pairs = [("a-b c", "A B...C", True), ("abc", "abd", False), ("", "?!", True), ("ab", "abc", False), ("x" * 5000 + "y", "X " * 5000 + "Y", True), ("x" * 5000 + "y", "x" * 5000 + "z", False)]
    columns = {f"{c}_{s}": [] for s in "ab" for c in ("state", "question", "choices")}
    for a, b, _ in pairs:
        for s, t in (("a", a), ("b", b)):
            columns[f"state_{s}"].append(t)
            columns[f"question_{s}"].append("q")
            columns[f"choices_{s}"].append(["k"])
    batch = pa.record_batch([pa.array(v) for v in columns.values()], list(columns))
    assert same_records(batch, stride).tolist() == [same for *_, same in pairs]


def test_layout_duplicates_hot_record(spark):
    df = spark.range(6000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Same  Text").otherwise(F.concat(F.lit("t"), "id")).alias("state"), F.lit("q").alias("question"), F.array(F.lit("a")).alias("choices")
    )
    got = layout_duplicates(df, "row_id")
    assert got.count() == 1999 and {r["rep"] for r in got.collect()} == {0}


def group_rows(rng, n):
    rows = []
    for g in range(n):
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            rows.append((f" G{g} " if rng.random() < 0.3 else f"g{g}", rng.choice(["train", "Dev", " test\t", "validation", "TRAIN"]), rng.choice(["a", "b"]), "x"))
    return rows


@pytest.mark.parametrize("per_block", [256, 4])
def test_split_groups(spark, per_block):
    rows = group_rows(random.Random(3), 400)
    rows += [("hub", "train", "a", "x")] * 150 + [(None, "train", "a", "x"), ("lost", None, "a", "x"), ("nolabel", "train", None, "x")]
    df = spark.createDataFrame(rows, "group_id string, split string, config string, n_rows string")
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, target_share double")
    got = split_groups(df, targets, per_block=per_block).toPandas()
    want, size, of_label = {}, {}, {}
    for g, s, label, _ in rows:
        if g and s:
            s, g = s.strip().lower(), g.strip().lower()
            want.setdefault(g, set()).add({"dev": "val", "validation": "val"}.get(s, s))
            size[g] = size.get(g, 0) + 1
            of_label.setdefault(label, {}).setdefault(g, 0)
            of_label[label][g] += 1
    assert dict(zip(got.group_id, got.divided)) == {g: len(s) > 1 for g, s in want.items()}
    assert dict(zip(got.group_id, got.n_rows)) == size
    assert got.group_id.is_unique and got.new_split.notna().all()
    share = got.groupby("new_split").n_rows.sum() / got.n_rows.sum()
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02
    new = dict(zip(got.group_id, got.new_split))
    for label in "ab":  # the labels' own quotas, blocks or not
        own = of_label[label]
        assert abs(sum(n for g, n in own.items() if new[g] == "train") / sum(own.values()) - 0.8) < 0.06
    shares = {r["split"]: r for r in split_shares(split_groups(df, targets), targets).collect()}
    assert abs(sum(r["share"] for r in shares.values()) - 1) < 1e-5 and sum(r["n_groups"] for r in shares.values()) == len(got)
    assert split_groups(df.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        split_groups(df, targets.limit(0))
    with pytest.raises(ValueError):
        split_groups(df, targets, max_splits=2)


def test_allocation_is_near_the_quotas():
    bundles = [(json.dumps([["a", s]]), s, n) for s, n in ((1, 31), (2, 17), (3, 9), (7, 5), (40, 1))]
    total = sum(s * n for _, s, n in bundles)
    fixed, room, _ = place_heavy(bundles[-1:], {"train": 0.7, "test": 0.3}, total)
    out = fixed | allocate(bundles[:-1], room)
    rows = {k: sum(s * out[p][k] for p, s, _ in bundles) for k in ("train", "test")}
    assert all(sum(out[p].values()) == n for p, _, n in bundles) and abs(rows["train"] - 0.7 * total) <= 4


def overlaps(df):
    links, members = split_overlap(df, "row_id")
    return {(r["id_e"], r["id_t"]): (r["jaccard"], r["coverage"]) for r in overlap_pairs(links, members).collect()}


def test_split_overlap(spark):
    base = [f"w{i}" for i in range(30)]
    near = " ".join(base[:28] + ["other"])
    rows = [
        (1, " ".join(base), "Q?", ["a"], "train"),
        (2, "! ".join(reversed(base)).upper(), "q", ["a"], "Test "),
        (3, near, "q", ["a"], "dev"),
        (4, near, "another", ["a"], "val"),
        (5, " ".join(base[:15]), "q", ["a"], "val"),
        (6, None, "q", ["a"], "val"),
        (7, " ", "q", ["a"], "val"),
        (8, "?!", "q", ["a"], "val"),
        (9, "?!", "q", ["a"], "train"),
        (10, " ".join(base), "q", ["a"], None),
        (11, "short", None, ["a"], "train"),
        (12, "SHORT", "", ["a"], "test"),
        (13, " ".join(base) + " w1" * 50_000, "q", ["a"], "validation"),
        (13, " ".join(base) + " w1" * 50_000, "q", ["a"], "validation"),
        (None, " ".join(base), "q", ["a"], "val"),
    ]
    df = table(spark, rows)
    got = overlaps(df)
    assert set(got) == {(2, 1), (3, 1), (12, 11), (13, 1)}
    assert abs(got[3, 1][0] - 28 / 31) < 1e-9 and abs(got[3, 1][1] - 28 / 29) < 1e-9
    assert got[2, 1] == (1.0, 0.0), "the same words backwards hold no passage"
    assert got[12, 11] == (1.0, 1.0)
    assert abs(got[13, 1][1] - 30 / 50_030) < 1e-9
    assert overlaps(df.limit(0)) == {}


def test_shard_merges_intervals():
    record = [f"w{i}" for i in range(12)]
    shard = Shard([record, ["a", "b"], []], 5)
    hit = shard.scan(record[:6] + ["x"] + record[7:] + ["a", "b"])
    assert shard.intervals(0, hit) == [(0, 6), (7, 12)] and shard.common(0, hit) == 11
    assert shard.intervals(1, hit) == [(0, 2)] and shard.intervals(2, hit) == []
    assert shard.intervals(1, shard.scan(["b", "a"])) == [] and shard.common(1, shard.scan(["b", "a"])) == 2


def test_split_overlap_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(160):
        own = rng.sample(words[: rng.choice([12, 20, 60])], rng.randint(1, 12))
        rows.append((i, " ".join(own), rng.choice(["a", "b"]), ["x"], rng.choice(["train", "val", "test"])))
    for i in range(40):
        own = rows[i][1].split()
        own.insert(len(own) // 2, "more")
        rows.append((200 + i, " ".join(own), rows[i][2], ["x"], rng.choice(["train", "val"])))
    got = overlaps(table(spark, rows))
    want = {}
    for a in rows:
        for b in rows:
            v, w = a[1].split(), b[1].split()
            x, y = set(v), set(w)
            if a[4] != "train" and b[4] == "train" and a[2] == b[2] and len(x & y) >= 0.8 * len(x | y):
                k = min(5, len(v))
                there = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
                covered = {i + o for i in range(len(v) - k + 1) if tuple(v[i : i + k]) in there for o in range(k)}
                want[a[0], b[0]] = (len(x & y) / len(x | y), len(covered) / len(v))
    assert set(got) == set(want) and len(want) > 20
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert len({c for _, c in want.values()}) > 2


def test_overlap_report(spark):
    rows = [(1, "a b c d e f", "q", ["x"], "train"), (2, "a b c d e f", "q", ["x"], "train"), (3, "A b c d e f", "q", ["x"], "val"), (4, "g h", "q", ["x"], "val"), (5, None, "q", ["x"], "test")]
    df = table(spark, rows)
    got = {(r["split"], r["source"]): tuple(r)[2:] for r in overlap_report(df.withColumn("source", F.lit("s")), *split_overlap(df, "row_id"), "row_id").collect()}
    assert got == {("val", "s"): (2, 1, 2, 1.0), ("test", "s"): (1, 0, 0, None)}
