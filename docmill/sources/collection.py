"""Stored vector collections: versions with an atomic swap, deletes without rewriting, compaction, pruning by payload.

A collection is a folder of parts (Parquet) and of versions, small JSON files
that name the parts and deletes that count. A change writes new files first and
then publishes the next version by a rename that fails if the version exists: of
two writers from one version one loses and has changed nothing, and a reader
keeps the version it began with. A put of a point hides its older rows as a
delete does; compaction writes what counts as one part.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Payload keys of a part whose least and largest values a version holds; a part with more has no statistics. Rows of a part's file.
STATISTICS, FILE_ROWS = 200, 500_000


class ConflictError(Exception):
    """Another writer has published the version first."""


class Collection:
    """Points ``(point_id, embedding, payload)`` in a folder that all of the cluster sees; payloads are maps of strings."""

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        self.spark, self.path, self.dimension = spark, path, dimension
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        fs, folder = self._fs(), self._at("versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's parts and deletes; the newest, if none is asked for; before the first there is nothing."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "next": 0, "parts": [], "deletes": []}
        stream = self._fs().open(self._at("versions", f"{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        """Makes a manifest the next version, or raises ConflictError."""
        fs, fresh = self._fs(), self._at("versions", f".{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self._conf).rename(fresh, self._at("versions", f"{manifest['version']}.json"), options)
        except Py4JJavaError as x:
            fs.delete(fresh, False)
            if "FileAlreadyExists" in x.java_exception.getClass().getName():
                raise ConflictError(f"version {manifest['version']} exists") from None
            raise
        return manifest["version"]

    def _next(self, base: int | None) -> dict:
        """The manifest that follows a version (the newest, if None)."""
        manifest = self.manifest(base)
        return manifest | {"version": manifest["version"] + 1, "next": manifest["next"] + 1}

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/{name}")
        return name

    def _part(self, name: str, number: int) -> dict:
        """A written part with its rows and the limits of its payloads' values: one aggregation by payload key."""
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        limits = rows.select(F.explode("payload").alias("k", "v")).groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).limit(STATISTICS + 1).collect()
        known = None if len(limits) > STATISTICS else {r.k: [r.lo, r.hi] for r in limits}
        return {"name": name, "number": number, "rows": rows.count(), "limits": known}

    def put(self, points: DataFrame, base: int | None = None) -> int:
        """Puts points in, in place of those of the same id, as a new version; ``base`` is the version that the writer has read.

        A null id, a vector of another dimension or two rows of one id fail the
        whole call before anything is published. A null payload is an empty one.
        """
        manifest = self._next(base)
        wrong = F.col("point_id").isNull() | F.coalesce(F.size("embedding") != self.dimension, F.lit(True))
        checked = points.select("point_id", F.when(wrong, F.raise_error(F.lit(f"a point needs an id and {self.dimension} numbers")).cast("array<float>")).otherwise(F.col("embedding").cast("array<float>")).alias("embedding"), F.coalesce(F.col("payload"), F.create_map().cast("map<string,string>")).alias("payload"))
        name = self._write(checked, "parts")
        written = self.spark.read.parquet(f"{self.path}/{name}").select("point_id")
        if written.groupBy("point_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError("two points of one id")
        if manifest["parts"]:
            manifest["deletes"] = [*manifest["deletes"], {"name": self._write(written, "deletes"), "number": manifest["next"]}]
        return self._publish(manifest | {"parts": [*manifest["parts"], self._part(name, manifest["next"])]})

    def delete(self, ids: DataFrame, base: int | None = None) -> int:
        """Hides the points of these ids (first column); ids that aren't there are fine."""
        manifest = self._next(base)
        name = self._write(ids.select(F.col(ids.columns[0]).alias("point_id")).where("point_id is not null").distinct(), "deletes")
        return self._publish(manifest | {"deletes": [*manifest["deletes"], {"name": name, "number": manifest["next"]}]})

    def delete_where(self, equals: dict[str, str], base: int | None = None) -> int:
        """Hides the points whose payload has all these values."""
        base = self.manifest(base)["version"]
        return self.delete(self.read(base, equals).select("point_id"), base)

    def parts(self, version: int | None = None, equals: dict[str, str] | None = None) -> list[dict]:
        """The parts that a read opens: those whose limits let the values be there."""
        may = lambda p: p["limits"] is None or all(k in p["limits"] and p["limits"][k][0] <= v <= p["limits"][k][1] for k, v in (equals or {}).items())
        return [p for p in self.manifest(version)["parts"] if may(p)]

    def read(self, version: int | None = None, equals: dict[str, str] | None = None) -> DataFrame:
        """The points of a version (the newest), of those with these payload values only."""
        manifest = self.manifest(version)
        schema = "point_id long, embedding array<float>, payload map<string,string>"
        parts = self.parts(manifest["version"], equals)
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{p['name']}").withColumn("_part", F.lit(p["number"])) for p in parts])
        for k, v in (equals or {}).items():
            rows = rows.where(F.try_element_at("payload", F.lit(k)) == v)
        oldest = min(p["number"] for p in parts)
        deletes = [d for d in manifest["deletes"] if d["number"] > oldest]
        if deletes:
            gone = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{d['name']}").withColumn("_until", F.lit(d["number"])) for d in deletes])
            gone = gone.groupBy("point_id").agg(F.max("_until").alias("_until")).withColumnRenamed("point_id", "_id")
            rows = rows.join(gone, (F.col("point_id") == F.col("_id")) & (F.col("_part") < F.col("_until")), "left_anti")
        return rows.drop("_part")

    def compact(self, base: int | None = None) -> int:
        """Writes the points that count as one part without deletes; older files stay for older versions."""
        manifest = self._next(base)
        name = self._write(self.read(manifest["version"] - 1), "parts")
        return self._publish(manifest | {"parts": [self._part(name, manifest["next"])], "deletes": []})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes versions but the newest ``keep``, and the files that no kept one names; returns their names. Not while others write."""
        fs, known = self._fs(), self.versions()
        old = known[: max(0, len(known) - keep)]
        named = {x["name"] for v in known[len(old) :] for m in [self.manifest(v)] for x in m["parts"] + m["deletes"]}
        there = {f"{kind}/{s.getPath().getName()}" for kind in ("parts", "deletes") if fs.exists(self._at(kind)) for s in fs.listStatus(self._at(kind))}
        for v in old:
            fs.delete(self._at("versions", f"{v}.json"), False)
        for name in (gone := sorted(there - named)):
            fs.delete(self._at(name), True)
        return gone
