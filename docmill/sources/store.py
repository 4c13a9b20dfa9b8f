"""Keyed and partitioned writes of Parquet tables, and vector collections with payloads.

A table is a folder of Parquet files. A change writes a new folder, which the
caller swaps in; a failed or repeated task so never leaves half a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmill.operators import relational as R


def append(df: DataFrame, path: str, batch: int = 1000) -> None:
    """Appends rows in files of at most ``batch`` rows."""
    df.write.option("maxRecordsPerFile", batch).mode("append").parquet(path)


def overwrite_keyed(spark: SparkSession, path: str, changes: DataFrame, key: str, to: str) -> DataFrame:
    """Writes the table at ``path`` with the changes' rows put in by key to a new folder, and returns it."""
    R.upsert(spark.read.parquet(path), changes, key).write.parquet(to)
    return spark.read.parquet(to)


def upsert_points(points: DataFrame, changes: DataFrame, dimension: int, key: str = "point_id") -> DataFrame:
    """A collection ``(key, embedding, payload)`` after an upsert: new vectors replace old ones, payloads (maps) are merged, the new value of a key wins.

    A change without a vector (null) merges its payload only; one of another
    dimension fails the whole upsert.
    """
    sized = F.when(F.size("embedding") != dimension, F.raise_error(F.lit(f"a vector's dimension is not {dimension}")).cast("array<float>")).otherwise(F.col("embedding"))
    new = changes.select(F.col(key).alias("_k"), sized.alias("_e"), F.col("payload").alias("_p"))
    empty = F.create_map().cast("map<string,string>")
    old, late = F.coalesce("payload", empty), F.coalesce("_p", empty)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(late), k))
    rows = points.select(key, "embedding", "payload").join(new, F.col(key) == F.col("_k"), "full_outer")
    return rows.select(F.coalesce(key, "_k").alias(key), F.coalesce("_e", "embedding").alias("embedding"), F.map_concat(kept, late).alias("payload"))


def delete_points(points: DataFrame, where: Column | None = None, ids: DataFrame | None = None, key: str = "point_id") -> DataFrame:
    """The collection without the points that meet a payload filter and those of the ids (each left out: none of that kind)."""
    if where is not None:
        points = points.where(~F.coalesce(where, F.lit(False)))
    return points if ids is None else points.join(ids.select(key).distinct(), key, "left_anti")


def write_by_month(df: DataFrame, ts: str, path: str) -> None:
    """Writes rows to one folder for each month of ``ts``, so that scans of some months read no other's files."""
    df.withColumn("month", F.date_format(ts, "yyyy-MM")).repartition("month", F.pmod(F.xxhash64(ts), F.lit(8))).write.partitionBy("month").mode("overwrite").parquet(path)


def archive(spark: SparkSession, path: str, before: str, to: str) -> DataFrame:
    """Copies the months before ``before`` (yyyy-MM) to an archive folder, and returns it; only those partitions are read."""
    spark.read.parquet(path).where(F.col("month").cast("string") < before).write.partitionBy("month").mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def download(files: DataFrame, allowed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stored content of files that the account may read; others give no row."""
    return files.join(allowed.select(key), key, "left_semi")
