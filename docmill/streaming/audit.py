"""Audit streams: windows of frequent events, appends, and file-driven ingestion. All work on batches too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def frequent(events: DataFrame, ts: str, by: str, length: str, slide: str, most: int, late: str = "10 minutes") -> DataFrame:
    """``(by, window_start, attempts)`` of sliding windows with more than ``most`` events; on a stream, with a watermark."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", late)
    counts = rows.groupBy(by, F.window("_ts", length, slide).alias("w")).agg(F.count("*").alias("attempts"))
    return counts.where(F.col("attempts") > most).select(by, F.col("w.start").alias("window_start"), "attempts")


# The audited actions.
ACTIONS = ("LOGIN", "LOGOUT", "UPLOAD", "QUERY", "DOWNLOAD", "DELETE", "CREATE", "UPDATE")


def entries(events: DataFrame, agent: str) -> DataFrame:
    """Audit rows: known actions only, the agent cut to 255 characters."""
    return events.where(F.col("action").isin(*ACTIONS)).withColumn("user_agent", F.left(F.col(agent), F.lit(255)))


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Appends a stream to a Parquet table; without an interval it takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(path)


def ingest(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs process(batch, number) on each batch of new rows, exactly once by number if process is idempotent in it."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
