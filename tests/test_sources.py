import gzip
import json

import pytest
from pyspark.sql import functions as F

from sievework.sources import files
from sievework.streaming import logs


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl.gz"
    with gzip.open(p, "wt") as f:
        f.write('{"id": "1", "state": "x"}\n\n{"id": "2"}\n')
    assert files.read_jsonl(spark, str(p), "id string, state string").count() == 2
    q = tmp_path / "b.jsonl"
    q.write_text('{"id": "1", "state": "x"}\nnot json\n{"id": "2"}\n')
    good, bad = files.read_jsonl_tolerant(spark, str(q), "id string, state string", ["state"])
    assert [r["id"] for r in good.collect()] == ["1"] and {(r["line"], r["reason"]) for r in bad.collect()} == {("not json", "not JSON"), ('{"id": "2"}', "no state")}
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(q), "id string").collect()


def test_other_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tb\n1\t"x\n')
    assert files.read_tsv(spark, str(tmp_path / "t.tsv")).first()["b"] == '"x'
    (tmp_path / "l.txt").write_text("one\n\n two\n")
    assert files.read_lines(spark, str(tmp_path / "l.txt")).count() == 2
    (tmp_path / "c.toml").write_text('[[task]]\nid = "a"\ntype = "noul"\nquestion = {instructions = "ok?"}\ncases = [{state = "s", expected = true}]\n')
    assert files.read_case_file(spark, str(tmp_path / "c.toml")).first()["question"] == "ok?"
    import hashlib

    digest = hashlib.sha256(b"one\n\n two\n").hexdigest()
    assert files.read_checked(spark, str(tmp_path / "l.txt"), digest).count() == 1
    with pytest.raises(Exception):
        files.read_checked(spark, str(tmp_path / "l.txt"), "00").collect()
    assert files.files_manifest(spark, str(tmp_path)).where(F.col("sha256") == digest).first()["bytes"] == 10


def test_append_new_and_digest(spark, tmp_path):
    path = str(tmp_path / "log")
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, x string")
    assert files.append_new(a, path, ["id"]) == 2 and files.append_new(a, path, ["id"]) == 0
    assert files.append_new(spark.createDataFrame([(3, "c")], "id int, x string"), path, ["id"]) == 1
    got = spark.read.parquet(path)
    assert got.count() == 3
    assert files.content_digest(got).first() == files.content_digest(got.orderBy(F.desc("id")).repartition(3)).first()
    files.write_table(got, str(tmp_path / "t"), by=["x"])
    assert files.read_table(spark, str(tmp_path / "t"), ["id"]).count() == 3


def test_replacing_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(spark.range(100), path, group_rows=30)
    assert spark.read.parquet(path).count() == 100
    import pyarrow.parquet as pq

    sizes = [pq.ParquetFile(f).metadata.row_group(0).num_rows for f in (tmp_path / "t").glob("*.parquet")]
    assert max(sizes) <= 30
    failing = spark.range(3).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        files.write_table(failing, path)
    assert spark.read.parquet(path).count() == 100
    files.write_table(spark.range(5).withColumn("x", F.lit(1)), path, schema="id bigint")
    assert spark.read.parquet(path).columns == ["id"] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception):
        files.write_table(spark.range(5), path, schema="id bigint, missing string not null")


def test_equal_rows_give_equal_bytes(spark, tmp_path):
    df = spark.range(500).select(F.col("id"), F.sha1(F.col("id").cast("string")).alias("a"))
    for name, rows in (("x", df), ("y", df.repartition(7).select("a", "id"))):
        files.write_sorted_gzip(rows, str(tmp_path / name), ["id"])
    x, y = (next((tmp_path / n).glob("*.gz")).read_bytes() for n in ("x", "y"))
    assert x == y and gzip.decompress(x).splitlines()[1].startswith(b'{"a":')
    files.write_sorted_gzip(df, str(tmp_path / "x"), ["id"], files=3)
    assert len(list((tmp_path / "x").glob("*.gz"))) == 3 and spark.read.json(str(tmp_path / "x")).count() == 500


def test_budgeted_read(spark, tmp_path):
    spark.range(4000).withColumn("x", F.sha1(F.col("id").cast("string"))).repartition(4).write.parquet(str(tmp_path / "t"))
    sizes = sorted(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    assert files.read_budgeted(spark, str(tmp_path / "t"), ["id"], 1).count() == 1000
    assert files.read_budgeted(spark, str(tmp_path / "t"), ["id"], 3 * sizes[-1]).count() >= 3000
    whole = files.read_budgeted(spark, str(tmp_path / "t"), ["id"], 10**9)
    assert whole.columns == ["id"] and whole.count() == 4000


def test_registry(spark):
    r = files.Registry()
    r.add("a/x", lambda s: s.range(2))
    r.add("b/y", lambda s: s.range(1).withColumn("z", F.lit(1)))
    assert r.select(["a/*"]) == ["a/x"] and r.load(spark, ["*"]).count() == 3
    with pytest.raises(KeyError):
        r.select(["c/*"])


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(i, f"2024-01-0{i + 1} 10:00:00"), (0, "2024-01-01 10:00:00")], "id int, t string").withColumn("t", F.col("t").cast("timestamp_ntz")).write.mode("append").parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    assert logs.append_once(spark, str(src), schema, ["id"]).count() == 3
    days = logs.windowed_counts(spark, str(src), schema, "t", "id")
    assert days.agg(F.sum("n")).first()[0] == 6
    s = logs.sessions(spark.read.parquet(str(src)), "t", "id")
    assert s.agg(F.sum("n")).first()[0] == 6
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    logs.decide_batches(logs.stream(spark, str(src), schema), lambda b: b.withColumn("answer", F.lit("yes")), out, check).awaitTermination()
    assert spark.read.json(out).count() == 6
    logs.decide_batches(logs.stream(spark, str(src), schema), lambda b: b, out, check).awaitTermination()
    assert spark.read.json(out).count() == 6
    assert json.loads(spark.read.json(out).toJSON().first())["answer"] == "yes"


def test_protocols(spark):
    from sievework.sources import protocols

    df = spark.createDataFrame([(1, "a", "b", 2, 0.4), (2, None, "b", 0, 2.0), (3, " ", "b", 9, None), (4, "x", None, 1, -1.0)], "id int, p string, h string, y int, z double")
    got = protocols.pair_items(df, F.col("id"), F.col("p"), F.col("h"), F.col("y"), ["l", "m", "n"], "?").collect()
    assert {(r["id"], r["state"], r["gold"]) for r in got} == {("1", "Premise: a\nHypothesis: b", 2)}
    got = protocols.scored_items(df, F.col("id"), F.col("h"), F.col("z"), ["low", "high"], 0, 1, "?").collect()
    assert {(r["id"], r["gold"]) for r in got} == {("1", 0), ("2", 1)}
    got = protocols.labelled_items(df, F.col("id"), F.col("h"), F.col("p"), ["a", "x_y"], "?").collect()
    assert [(r["id"], r["gold"], r["choices"]) for r in got] == [("1", 0, ["a", "x y"])]
    ranked = protocols.ranked_items(df.where("h = 'b'"), F.col("h"), F.col("id").cast("string"), F.col("y"), F.col("id"), most=2).collect()
    assert [(r["choices"], r["gold"]) for r in ranked] == [(["1", "2"], 0)]
    assert protocols.binary_items(df.limit(0), F.col("id"), F.col("h"), F.col("y") > 0, "?").collect() == []


def test_training_batches(spark):
    from sievework.operators import batches

    rows = [(i, "x" * (i % 90) * 20, "q" * (i % 7), ["o"] * (i % 11 + 1)) for i in range(700)] + [(1000, None, None, None), (1001, "y", "q", ["o"] * 80)]
    df = spark.createDataFrame(rows, "id long, state string, question string, choices array<string>")
    got = batches.training_batches(df, "id", choice_budget=40, max_states=8, token_budget=1500, chunk=200).toPandas()
    assert sorted(got.id) == sorted(r[0] for r in rows)
    for _, b in got.groupby(["chunk", "batch"]):
        assert len(b) == 1 or (b.n_options.sum() <= 40 and len(b) <= 8 and b.tokens.max() * len(b) <= 1500)
    other = batches.training_batches(df, "id", choice_budget=40, max_states=8, token_budget=1500, chunk=200, seed=1).toPandas()
    assert not got.set_index("id").chunk.equals(other.set_index("id").chunk)
    assert batches.training_batches(df.limit(0), "id").collect() == []
