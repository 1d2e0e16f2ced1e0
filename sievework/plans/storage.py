"""Readers, writers and logs exercised on whole tables: what is written comes back the same."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import decode as D
from sievework.functions import text as T
from sievework.operators import decide
from sievework.plans.decisions import _SPEC_ROWS, _W, SPEC
from sievework.session import _remove, shared_dir, table
from sievework.sources import files
from sievework.streaming import logs

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _place(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


_ITEM = "id string, suite string, kind string, question string, choices array<string>, gold int, state string"


def _items(spark, d) -> DataFrame:
    return table(spark, d, "items").select("id", "suite", "kind", "question", "choices", "gold", "state")


def _digest(df: DataFrame) -> DataFrame:
    return df.select("id", "suite", "gold", F.size("choices").alias("n_choices"), F.md5(F.concat_ws("|", "kind", "question", F.array_join("choices", "~"), "state")).alias("digest"))


_DIGEST = "SELECT id, suite, gold, len(choices)::INT AS n_choices, md5(concat_ws('|', kind, question, array_to_string(choices, '~'), state)) AS digest FROM items"


@query(_DIGEST)
def s01_json_lines(spark, d):
    path = _place(spark, "jsonl")
    files.write_jsonl(_items(spark, d), path)
    return _digest(files.read_jsonl(spark, path, _ITEM))


@query(_DIGEST)
def s03_sorted_gzip(spark, d):
    path = _place(spark, "gzip")
    files.write_sorted_gzip(_items(spark, d), path, ["id"], files=4)
    return _digest(files.read_jsonl(spark, path, _ITEM))


@query("SELECT id, suite, kind, replace(replace(question, chr(9), ' '), chr(10), ' ') AS question FROM items")
def s04_tab_separated(spark, d):
    path = _place(spark, "tsv")
    flat = _items(spark, d).select("id", "suite", "kind", F.translate("question", "\t\n", "  ").alias("question"))
    flat.select(F.concat_ws("\t", *flat.columns).alias("value")).write.text(path)
    return files.read_tsv(spark, path, header=False).toDF(*flat.columns)


@query("SELECT 'kept' AS what, count(*) AS n FROM examples WHERE state IS NOT NULL AND row_id % 10 <> 0 UNION ALL SELECT 'not JSON', count(*) FROM examples WHERE row_id % 10 = 0 UNION ALL SELECT 'no state', count(*) FROM examples WHERE state IS NULL AND row_id % 10 <> 0")
def s08_tolerant_lines(spark, d):
    """Every tenth line is cut off: rejects come out with their reason, and nothing else is lost."""
    path = _place(spark, "lines")
    line = F.to_json(F.struct("row_id", "state"))
    table(spark, d, "examples").select(F.when(F.col("row_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")).write.text(path)
    good, bad = files.read_jsonl_tolerant(spark, path, "row_id bigint, state string", ["state"])
    return good.agg(F.lit("kept").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(bad.groupBy(F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT doc_id, md5(text) AS digest, coalesce(n_chars, -1)::BIGINT AS n_chars, lang FROM documents")
def s12_table_sink(spark, d):
    """Documents written twice to one place, with a schema and bounded row groups: the second table takes the place of the first."""
    path = _place(spark, "table")
    rows = table(spark, d, "documents").select("doc_id", "text", "n_chars", "lang")
    files.write_table(rows.where("doc_id % 2 = 0"), path)
    files.write_table(rows.withColumn("more", F.lit(1)), path, schema="doc_id bigint, text string, n_chars bigint, lang string", group_rows=20_000)
    return files.read_table(spark, path).select("doc_id", F.md5("text").alias("digest"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"), "lang")


@query("SELECT system_name, count(*) AS n FROM (SELECT DISTINCT system_name, id FROM preds) GROUP BY system_name")
def s15_append_log(spark, d):
    """Predictions appended in two deliveries that overlap; each key is in the log once."""
    path, rows = _place(spark, "log"), table(spark, d, "preds").select("system_name", "id")
    files.append_new(rows.where("system_name <> 'rules'"), path, ["system_name", "id"])
    files.append_new(rows, path, ["system_name", "id"])
    return spark.read.parquet(path).groupBy("system_name").agg(F.count(F.lit(1)).alias("n"))


_CASE = f"""WITH q(qid, kind, options, keys, need) AS (VALUES {_SPEC_ROWS}), s AS (SELECT row_id, {_W.format("state")} AS w FROM examples WHERE state IS NOT NULL),
    z AS (SELECT row_id, keys, list_transform(options, lambda o: len(list_intersect(w, {_W.format("o")})) * 1.0 / len({_W.format("o")})) AS z FROM s, q WHERE qid = 'team') SELECT row_id AS id, 'team' AS qid, keys[list_position(z, list_max(z))] AS answer FROM z"""


@query(_CASE)
def t04_decision_log(spark, d):
    """Decisions on the micro-batches of a stream, read back from their log of JSON lines."""
    out, check = _place(spark, "decisions"), _place(spark, "checkpoint")
    source = logs.stream(spark, f"{d}/examples.parquet", table(spark, d, "examples").schema)
    logs.decide_batches(source, lambda b: decide.decide(b, "row_id", "state", {"team": SPEC["team"]}).select("id", "qid", "answer"), out, check).awaitTermination()
    return spark.read.schema("id bigint, qid string, answer string").json(out).select("id", "qid", "answer")


@query("""SELECT row_id, md5(array_to_string(list_transform(json_keys(state), lambda k: json_extract_string(state, '$."' || k || '"')), ' ')) AS digest FROM examples WHERE json_valid(state) AND json_type(state) = 'OBJECT'""")
def p19_unwrapped(spark, d):
    """The string values of JSON states."""
    rows = table(spark, d, "examples").where(F.json_object_keys("state").isNotNull())
    return rows.select("row_id", F.md5(T.unwrap_json(F.col("state"))).alias("digest"))


@query("SELECT id, trim(question) AS line FROM items")
def p26_without_cd(spark, d):
    """Questions behind two changes of folder, which go."""
    return table(spark, d, "items").select("id", D.strip_cd(F.concat(F.lit(" cd /srv/app && cd 'my files'; "), F.trim("question"))).alias("line"))


@query("""SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', 'user@example.org', 'g')) AS digest FROM (SELECT doc_id, replace(text, '.example', '.shop') AS text FROM documents WHERE contains(text, '@'))""")
def p29_scrubbed(spark, d):
    """Addresses moved off the reserved domains and then scrubbed."""
    rows = table(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.replace("text", F.lit(".example"), F.lit(".shop")).alias("text"))
    return rows.select("doc_id", F.md5(T.scrub_emails(F.col("text"))).alias("digest"))


QUERIES = Q
