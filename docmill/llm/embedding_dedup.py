"""Near duplicates of embeddings: Euclidean p-stable hashing, then exact cosines.

Normalised vectors get, in each of several tables, the bucket of ``hashes``
quantised Gaussian projections floor((a.v + b) / width). Vectors of one bucket
are compared exactly, in double precision, block by block; a pair counts in the
first table that has both in one bucket, so no pair is counted twice and none is
ever written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import cut, groups
from docmill.llm.components import components

#: Width of a quantised projection of normalised vectors.
WIDTH = 2.2
#: Vectors of a block; a larger bucket is compared block against block.
BLOCK = 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for two vectors at this distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Plan:
    """Number of tables and of hashes in each."""

    tables: int
    hashes: int

    @classmethod
    def of(cls, rows: int, threshold: float, miss: float = 0.01, mates: float = 20.0) -> Plan:
        """For that many vectors: unrelated ones (at a right angle) share a bucket with about ``mates`` others, and a pair at the very threshold is missed in all tables with chance ``miss`` (closer pairs far more rarely)."""
        near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
        hashes = max(4, math.ceil(math.log(max(rows / mates, 2)) / -math.log(far)))
        return cls(math.ceil(math.log(miss) / math.log(1 - near**hashes)), hashes)


def valid(col: str):
    """Whether a vector takes part: not null, no null or non-finite component, not zero, of finite length."""
    v = F.col(col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _codes(x: np.ndarray, plan: Plan, seed: int) -> np.ndarray:
    """The 32-bit bucket code of each row (normalised) in each table."""
    r = np.random.default_rng([seed, x.shape[1]])
    out = np.empty((len(x), plan.tables), np.int32)
    for t in range(plan.tables):
        a = r.standard_normal((x.shape[1], plan.hashes))
        q = np.floor((x @ a + r.uniform(0, WIDTH, plan.hashes)) / WIDTH).astype(np.int64).astype(np.uint64)
        h = np.full(len(x), t + 1, np.uint64)
        for j in range(plan.hashes):
            h = (h ^ q[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, t] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    return np.array([np.frombuffer(x, dtype) for x in column.to_pylist()])


def _compare(x, y, norm_x, norm_y, codes_x, codes_y, table, threshold, same):
    """Links of rows and columns: which are new in this table, and all."""
    fresh = np.ones((len(x), len(y)), bool)
    if same:
        fresh = np.triu(fresh, 1)
    for s in range(table):
        fresh &= codes_x[:, s][:, None] != codes_y[:, s][None, :]
        if not fresh.any():
            return None
    close = (x @ y.T) / (norm_x[:, None] * norm_y[None, :]) >= threshold
    return close & fresh


def _roots(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, by label propagation."""
    root = np.arange(n)
    while len(rows):
        new = root.copy()
        np.minimum.at(new, rows, root[cols])
        np.minimum.at(new, cols, root[rows])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7, plan: Plan | None = None) -> DataFrame:
    """One row for each row of vectors: ``(id, n_links, component_id, kept)``.

    n_links counts the other rows at this cosine or more (found in some table),
    component_id is the smallest id reachable, kept marks it. Equal vectors are
    compared once, with their number as a weight. A bucket of many vectors is
    dealt out as pairs of blocks, each a task's group of its own, whose result
    is two numbers a vector. Vectors that are null, zero or hold null or
    non-finite components, and rows without an id, link with nothing; vectors of
    different length do not link. Rows with one id are rows of their own to n_links. Other
    columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", valid("v") & F.col("id").isNotNull())
    keyed = rows.where("ok").withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.reverse("v"), F.lit(1)))
    reps = keyed.groupBy("k1", "k2").agg(F.min(F.struct("id", "v")).alias("m"), F.count("*").alias("copies")).select(F.col("m.id").alias("rep"), F.col("m.v").alias("v"), "copies", "k1", "k2")
    reps = cut(reps)
    plan = plan or Plan.of(reps.count(), threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_size: dict[int, list[int]] = {}
            listed = b.column(1).to_pylist()
            for i, v in enumerate(listed):
                by_size.setdefault(len(v), []).append(i)
            for at in by_size.values():
                for lo in range(0, len(at), 2_000):
                    part = at[lo : lo + 2_000]
                    x = np.array([listed[i] for i in part])
                    scaled = x / np.abs(x).max(1, keepdims=True)
                    codes = _codes(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), plan, seed)
                    take = b.take(pa.array(part))
                    narrow = (x.astype(np.float32) == x).all(1).tolist()
                    stored = [x[i].astype("<f4" if f else "<f8").tobytes() for i, f in enumerate(narrow)]
                    yield pa.record_batch([take.column(0), take.column(2), pa.array(narrow), pa.array(stored, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int32()))], ["rep", "copies", "narrow", "x", "codes", "each"])

    coded = reps.select("rep", "v", "copies").mapInArrow(hashed, "rep long, copies long, narrow boolean, x binary, codes binary, each array<int>")
    coded = cut(coded)
    spread = coded.select("rep", F.posexplode("each").alias("t", "code"))
    sizes = spread.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1").select("t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = coded.select("rep", "copies", "narrow", "x", "codes", F.posexplode("each").alias("t", "code")).join(sizes, ["t", "code"])
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "narrow", "x", "codes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[int]] = [[], [], []]
        for g in groups(batches, 4):
            if g.num_rows > 1:
                _group(g, threshold, out)
            if len(out[0]) > 20_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["rep", "n", "root"])
                out = [[], [], []]
        if out[0]:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["rep", "n", "root"])

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(n, "t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j", "own", "rep")
    found = cut(found.mapInArrow(compare, "rep long, n long, root long"))
    joined = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    by_rep = reps.select("rep", "copies", "k1", "k2").join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    by_rep = by_rep.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    good = keyed.select("id", "k1", "k2").join(by_rep, ["k1", "k2"]).select("id", "n", "c")
    bad = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    result = good.unionByName(bad)
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


def _group(g: pa.Table, threshold: float, out: list[list[int]]) -> None:
    """Compares the rows of one pair of blocks; appends (rep, links, smallest linked rep) of each row that has links."""
    table, i, j = g.column(0)[0].as_py(), g.column(2)[0].as_py(), g.column(3)[0].as_py()
    own, rep, copies = (g.column(k).to_numpy() for k in (4, 5, 6))
    vectors = [np.frombuffer(x, "<f4" if f else "<f8").astype(np.float64) for f, x in zip(g.column(7).to_pylist(), g.column(8).to_pylist())]
    codes = _matrix(g.column(9), np.int32)
    size = np.array([len(v) for v in vectors])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x, c = np.array([vectors[k] for k in at]), codes[at]
        x = x / np.abs(x).max(1, keepdims=True)
        norm = np.linalg.norm(x, axis=1)
        a, b = np.flatnonzero(own[at] == i), np.flatnonzero(own[at] == j)
        if i != j:
            sides = [(a[lo : lo + BLOCK], b[k : k + BLOCK], False) for lo in range(0, len(a), BLOCK) for k in range(0, len(b), BLOCK)]
        else:
            starts = range(0, len(a), BLOCK)
            sides = [(a[lo : lo + BLOCK], a[k : k + BLOCK], lo == k) for lo in starts for k in starts if lo <= k]
        rows, cols = [], []
        for p, q, same in sides:
            hit = _compare(x[p], x[q], norm[p], norm[q], c[p], c[q], table, threshold, same)
            if hit is not None:
                u, v = np.nonzero(hit)
                rows.append(p[u])
                cols.append(q[v])
        if not rows or not sum(map(len, rows)):
            continue
        u, v = np.concatenate(rows), np.concatenate(cols)
        weight = copies[at]
        n = np.bincount(u, weight[v], len(at)) + np.bincount(v, weight[u], len(at))
        ids = rep[at]
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        root = ids[order][_roots(len(at), rank[u], rank[v])][rank]
        for k in np.flatnonzero(n > 0):
            out[0].append(int(ids[k]))
            out[1].append(int(n[k]))
            out[2].append(int(root[k]))
