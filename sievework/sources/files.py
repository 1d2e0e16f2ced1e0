"""Readers and writers of record files."""

from __future__ import annotations

import fnmatch
import tomllib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sievework.session import stage

EXAMPLE = "id string, kind string, state string, question string, choices array<string>, gold int, probs array<double>, state_lang string, choice_lang string"
ITEM = "id string, suite string, lang string, kind string, question string, choices array<string>, gold int, split string, state string, group_id string, perm array<int>"
PREDICTION = "system_name string, id string, probs array<double>"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object a line, gzip included; blank lines are skipped. A line that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str | StructType, needs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): lines that don't parse, and rows without one of the needed fields, go to rejects as text with the reason.
    The input is read and parsed once, into a staged table that both come from."""
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*own.fields, StructField("_corrupt", StringType())])
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    reason = F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "not JSON")
    for c in needs:
        reason = reason.when(F.col(f"r.{c}").isNull(), f"no {c}")
    parsed = stage(parsed.withColumn("reason", reason), "lines")
    return parsed.where("reason IS NULL").select(*[f"r.{f.name}" for f in own.fields]), parsed.where("reason IS NOT NULL").select(F.col("value").alias("line"), "reason")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_budgeted(spark: SparkSession, path: str, columns: list[str], max_bytes: int) -> DataFrame:
    """The columns of as many of a folder's Parquet files, in the order of their names, as have at most max_bytes together (at least
    one): a look into a table that is too large to read. Sizes come from the listing; no other file is opened."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length").orderBy("path")
    chosen, total = [], 0
    for r in listing.toLocalIterator():
        if chosen and total + r["length"] > max_bytes:
            break
        chosen.append(r["path"])
        total += r["length"]
    return spark.read.parquet(*chosen).select(*columns)


def read_tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Tab-separated text in which quotation marks mean nothing."""
    return spark.read.option("sep", "\t").option("quote", "").option("header", header).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text a line, blank lines left out."""
    return spark.read.text(path).select(F.col("value").alias("text")).where(F.trim("text") != "")


def read_case_file(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a TOML file with [[task]] entries (id, type, question, cases): small hand-written files, read on the driver."""
    with open(path, "rb") as f:
        tasks = tomllib.load(f).get("task", [])
    rows = [(t["id"], t.get("type"), (t.get("question") or {}).get("instructions"), i, c["state"] if isinstance(c["state"], str) else str(c["state"]), str(c.get("expected"))) for t in tasks for i, c in enumerate(t.get("cases", []))]
    return spark.createDataFrame(rows, "task string, type string, question string, number int, state string, expected string")


def read_checked(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A file's bytes, refused unless their digest is the one given."""
    row = spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))
    return row.withColumn("content", F.when(F.col("sha256") == sha256, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "sha256"))))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, schema: str | StructType | None = None, group_rows: int | None = None) -> None:
    """Compressed Parquet that takes the place of what is there only when it is whole (see replace_folder). schema: the columns and
    types the table must have; a column that is missing or doesn't fit is an error. group_rows: the most rows of a row group."""
    if schema is not None:
        df = df.to(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def write(place: str) -> None:
        w = df.write.option("compression", "zstd")
        if group_rows:
            w = w.option("parquet.block.row.count.limit", group_rows)
        (w.partitionBy(*by) if by else w).parquet(place)

    replace_folder(df.sparkSession, path, write)


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside the path, then change names: a reader sees the old folder or the new one, and a failure before the change leaves
    the old one as it was. What stood there is put aside first and deleted last."""
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(new)
        there = fs.exists(hadoop(path))
        if there:
            fs.rename(hadoop(path), hadoop(old))
        if not fs.rename(hadoop(new), hadoop(path)):
            if there:
                fs.rename(hadoop(old), hadoop(path))
            raise OSError(f"cannot put {path} in its place")
        if there:
            fs.delete(hadoop(old), True)
    finally:
        fs.delete(hadoop(new), True)


def write_sorted_gzip(df: DataFrame, path: str, order: list[str], files: int = 1) -> None:
    """JSON lines in order, compressed: each file holds a range, fields are sorted by name and the archive has no time stamp, so equal rows
    give equal bytes. With more than one file the ranges' borders come from a sample, as range partitioning has it."""
    rows = df.select(*sorted(df.columns))
    ranged = rows.coalesce(1).sortWithinPartitions(*order) if files == 1 else rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    replace_folder(df.sparkSession, path, lambda place: ranged.write.option("compression", "gzip").json(place))


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys aren't in the table yet; returns how many there were. Safe to run again after a failure."""
    spark = df.sparkSession
    rows = df.dropDuplicates(keys)
    try:
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:  # noqa: BLE001 - the first run finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def content_digest(df: DataFrame) -> DataFrame:
    """(n, digest): a digest of a table's content that depends on neither order nor files."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 14), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("digest"))


def files_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class Registry:
    """Named loaders, selected by patterns."""

    def __init__(self) -> None:
        self.loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
        self.loaders[name] = loader

    def select(self, patterns: list[str]) -> list[str]:
        """Names that match, in the order of registration; a pattern that matches nothing is an error."""
        for p in patterns:
            if not fnmatch.filter(self.loaders, p):
                raise KeyError(p)
        return [n for n in self.loaders if any(fnmatch.fnmatch(n, p) for p in patterns)]

    def load(self, spark: SparkSession, patterns: list[str]) -> DataFrame:
        frames = [self.loaders[n](spark).withColumn("suite", F.lit(n)) for n in self.select(patterns)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out


def label_names(c: Column, names: list[str]) -> Column:
    """Class numbers to their names."""
    return F.get(F.array(*map(F.lit, names)), c.cast("int"))
