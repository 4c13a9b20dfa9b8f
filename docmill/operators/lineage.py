"""Cutting the lineage of a growing plan, spreading few partitions, and broadcasting what is known to be small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that are broadcast at most, after counting them.
SMALL = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a temporary one only where none is set, as in tests), set as checkpoint folder."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='docmill-')}")
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of scratch by Hadoop's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has fewer partitions than there are cores (a single small file); else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The rows with a broadcast hint if they are no more than ``most``; beyond that Spark joins by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
