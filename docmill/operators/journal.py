"""Uploads with a durable log: a lost driver goes on at the last step that is written, and nothing is stored twice.

An attempt has a number of its own. It writes, each as a folder that counts once
it is whole: the documents that it takes (processing), their points and outcomes
(prepared), and that these count (published). A document belongs to the newest
attempt that has taken it, so what an older, slower one publishes later is
fenced off; points count only with their document's published attempt.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.operators.ingest import ingest

#: Steps of an attempt, in order.
STEPS = ("taken", "points", "outcomes", "published")


class UploadJournal:
    """The log and the points of uploads in a folder that all of the cluster sees."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", on_step: Callable[[str], None] | None = None):
        self.spark, self.path, self.id_col, self.on_step = spark, path, id_col, on_step or (lambda step: None)
        self._jvm = spark.sparkContext._jvm

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def attempts(self, step: str = "taken") -> list[int]:
        """Numbers of the attempts whose step is whole."""
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self._at("log"))] if fs.exists(self._at("log")) else []
        return sorted(int(n[8:]) for n in names if n.startswith("attempt=") and fs.exists(self._at(f"log/{n}/{step}/_SUCCESS")))

    def _claim(self) -> int:
        """A number that no other attempt has: the first whose file can be made."""
        fs = self._fs()
        fs.mkdirs(self._at("numbers"))
        n = max([int(s.getPath().getName()) for s in fs.listStatus(self._at("numbers"))], default=0) + 1
        while not fs.createNewFile(self._at(f"numbers/{n}")):
            n += 1
        return n

    def _write(self, rows: DataFrame, attempt: int, step: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/log/attempt={attempt}/{step}")
        self.on_step(step)

    def _read(self, step: str, attempts: list[int]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/log/attempt={n}/{step}").withColumn("attempt", F.lit(n)) for n in attempts]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def status(self, docs: DataFrame) -> DataFrame:
        """``(id, status, attempt, error)`` of every document: pending, processing, completed or failed, by the newest attempt that has taken it."""
        taken = self._read("taken", self.attempts())
        ids = docs.select(self.id_col).distinct()
        if taken is None:
            return ids.select(self.id_col, F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("error"))
        owner = taken.groupBy(self.id_col).agg(F.max("attempt").alias("attempt"))
        rows = ids.join(owner, self.id_col, "left")
        outcomes = self._read("outcomes", self.attempts("published"))
        if outcomes is None:
            return rows.select(self.id_col, F.when(F.col("attempt").isNull(), "pending").otherwise("processing").alias("status"), F.coalesce("attempt", F.lit(0)).alias("attempt"), F.lit(None).cast("string").alias("error"))
        rows = rows.join(outcomes.select(self.id_col, "attempt", "status", "error"), [self.id_col, "attempt"], "left")
        return rows.select(self.id_col, F.coalesce("status", F.when(F.col("attempt").isNull(), "pending").otherwise("processing")).alias("status"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "error")

    def points(self) -> DataFrame | None:
        """The points that count: those of each completed document's newest attempt, if that has published them; None before any."""
        published = self.attempts("published")
        if not published:
            return None
        owner = self._read("taken", self.attempts()).groupBy(self.id_col).agg(F.max("attempt").alias("attempt"))
        return self._read("points", published).join(owner, [self.id_col, "attempt"], "left_semi").drop("attempt")

    def transitions(self) -> DataFrame:
        """``(id, attempt, step, from_status, to_status)``: what the log says of each document, attempt by attempt."""
        taken = self._read("taken", self.attempts())
        before = F.lag("attempt").over(self._order())
        first = taken.select(self.id_col, "attempt", F.lit(1).alias("step"), F.when(before.isNull(), "pending").otherwise("processing").alias("from_status"), F.lit("processing").alias("to_status"))
        outcomes = self._read("outcomes", self.attempts("published"))
        if outcomes is None:
            return first
        owner = taken.groupBy(self.id_col).agg(F.max("attempt").alias("attempt"))
        last = outcomes.join(owner, [self.id_col, "attempt"], "left_semi").select(self.id_col, "attempt", F.lit(2).alias("step"), F.lit("processing").alias("from_status"), F.col("status").alias("to_status"))
        return first.unionByName(last)

    def _order(self):
        from pyspark.sql import Window

        return Window.partitionBy(self.id_col).orderBy("attempt")

    def _publish(self, attempt: int) -> None:
        """Makes a prepared attempt count, by a small folder of its own."""
        self._write(self.spark.createDataFrame([(attempt,)], "attempt int"), attempt, "published")

    def run(self, docs: DataFrame, text_col: str, embedder: Callable[[list], list], dimension: int, retry_failed: bool = False, **options) -> int:
        """Ingests the documents that have no outcome yet (failed ones, too, if asked), and returns the attempt's number, 0 if nothing was left.

        First, what an earlier run had prepared but not published is published,
        without a call of the embedder. A document that another attempt is at
        is taken over: whichever attempt is newer counts.
        """
        published = self.attempts("published")
        for n in self.attempts("outcomes"):
            if n not in published:
                self._publish(n)
        open_ = ["pending", "processing", "failed"] if retry_failed else ["pending", "processing"]
        todo = self.status(docs).where(F.col("status").isin(open_)).select(self.id_col)
        if not todo.limit(1).count():
            return 0
        attempt = self._claim()
        self._write(todo, attempt, "taken")
        mine = self.spark.read.parquet(f"{self.path}/log/attempt={attempt}/taken")
        points, status = ingest(docs.join(mine, self.id_col, "left_semi"), self.id_col, text_col, embedder, dimension, **options)
        self._write(points, attempt, "points")
        self._write(status, attempt, "outcomes")
        self._publish(attempt)
        return attempt
