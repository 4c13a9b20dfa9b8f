"""Uploads as they arrive, and tables that are rebuilt at intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.ingest import ingest


def process(stream: DataFrame, id_col: str, text_col: str, embedder: Callable[[list], list], dimension: int, points: str, status: str, checkpoint: str, **options):
    """Ingests the stream's new documents batch by batch: points of whole documents to one folder, outcomes to another.

    A batch's files stand in a folder of their own (``batch=n``), written anew if
    the batch is repeated after a failure, so that nothing is stored twice.
    """

    def batch(docs: DataFrame, n: int) -> None:
        made, outcome = ingest(docs, id_col, text_col, embedder, dimension, **options)
        made.write.mode("overwrite").parquet(f"{points}/batch={n}")
        outcome.write.mode("overwrite").parquet(f"{status}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(spark: SparkSession, rebuild: Callable[[], DataFrame], path: str, checkpoint: str, every: str = "30 minutes"):
    """Rebuilds a table at each tick: version n stands in ``version=n``, and readers take the largest that is whole (has _SUCCESS)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.lit(1).alias("tick"))
    writer = ticks.writeStream.foreachBatch(lambda _, n: rebuild().write.mode("overwrite").parquet(f"{path}/version={n}"))
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The largest whole version of a table that refresh rebuilds; fails if there is none yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=")]
    whole = [int(n[8:]) for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not whole:
        raise FileNotFoundError(f"no whole version below {path}")
    return spark.read.parquet(f"{path}/version={max(whole)}")
