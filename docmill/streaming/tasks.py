"""Task queue transitions as batch steps; queue.py has the stateful stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def start(tasks: DataFrame, now: str) -> DataFrame:
    """Marks tasks running from now."""
    return tasks.withColumn("status", F.lit("running")).withColumn("started_at", F.lit(now).cast("timestamp_ntz"))


def progress(tasks: DataFrame, percent: str) -> DataFrame:
    """Clamps a progress column to 0..100."""
    return tasks.withColumn("progress", F.least(F.lit(100), F.greatest(F.lit(0), F.col(percent))))


def fail(tasks: DataFrame, now: str, most: int) -> DataFrame:
    """After a failure: one more retry at now + 5 min * 2^retries, or failed for good when there are ``most``."""
    n = F.col("retry_count") + 1
    spent = n >= most
    wait = F.make_interval(mins=(5 * F.pow(F.lit(2), n)).cast("int"))
    return tasks.withColumns({
        "status": F.when(spent, "failed").otherwise("retrying"),
        "next_retry_at": F.when(~spent, F.lit(now).cast("timestamp_ntz") + wait),
        "retry_count": n,
    })


def compare_and_set(rows: DataFrame, lock: str, expected: int, **values) -> DataFrame:
    """Sets the values where the lock has the expected version, and raises the version there."""
    hit = F.col(lock) == expected
    out = rows.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})
    return out.withColumn(lock, F.when(hit, F.col(lock) + 1).otherwise(F.col(lock)))
