"""Connected components of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in the edges ``(a, b)``; component is the smallest id reachable.

    Large-star and small-star steps in turn until nothing changes: every step
    links the neighbours of an id to the smallest of them, so ever more ids
    hang on their component's smallest id. A step is one aggregation and one
    join by id (a hub's rows are split by Spark's skew handling); only counts
    reach the driver. Loops, repeated edges and empty input are fine.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), "m", "u")
        small = small.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        new = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
