"""Incremental forms: append once, counts by event time, decisions per micro-batch."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.session import _remove, shared_dir


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A file stream over a Parquet table, which may be one file or a folder of them."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        folder, name = os.path.split(local)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _to_table(df: DataFrame, mode: str) -> DataFrame:
    """Run the stream to the end of what there is now, into a table in the shared folder, and read that."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, base)
    writer = df.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").outputMode("append").start().awaitTermination()
    else:
        writer.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def append_once(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Rows of a stream, each key once: what an append-only log keeps when deliveries repeat. State is one key a row; with an
    event-time column, give a watermark to bound it (see append_once_within)."""
    return _to_table(stream(spark, path, schema).dropDuplicates(keys), "append")


def append_once_within(df: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """dropDuplicates whose state is bounded by a watermark; rows later than the delay may repeat."""
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(spark: SparkSession, path: str, schema: StructType, event_time: str, key: str, width: str = "1 day") -> DataFrame:
    """(day, key, n) by tumbling windows of event time."""
    rows = stream(spark, path, schema).withColumn("_t", F.col(event_time).cast("timestamp")).withWatermark("_t", "2 days")
    counts = rows.groupBy(F.window("_t", width), key).agg(F.count(F.lit(1)).alias("n"))
    out = _to_table(counts, "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), key, "n")


def sessions(df: DataFrame, event_time: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(session, key, n) by session windows, for a stream or a table."""
    rows = df.withColumn("_t", F.col(event_time).cast("timestamp"))
    rows = rows.withWatermark("_t", delay) if df.isStreaming else rows
    return rows.groupBy(F.session_window("_t", gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"))


def decide_batches(df: DataFrame, decide: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> object:
    """Decisions for each micro-batch of a stream, appended as JSON lines. A batch that is tried again overwrites its own part,
    so a restart neither loses nor repeats decisions."""

    def one(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").json(f"{out_path}/batch={number}")

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def disagreements(df: DataFrame, rule: str, model: str, confidence: str, least: float = 0.8) -> DataFrame:
    """Rows of a log in which a rule and a sure model differ."""
    return df.where((F.col(rule) != F.col(model)) & (F.col(confidence) >= least))
