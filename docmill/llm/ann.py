"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has, in each tree, a string of 32 bits: the signs of random
projections of the centred vector, with one more component that gives all of
them the same length (so that the largest inner product is the smallest angle).
A query's strings are those of the query itself with 0 there: the centre adds
the same to all its inner products. A tree is the sorted array of its strings.
A query descends each tree to its longest matching prefix; then all trees
ascend together, one bit at a time, and at each length give the run of strings
that share the prefix, tree by tree until enough candidates are in hand.
Candidates are ranked exactly by the inner product in double precision.

How many candidates are enough is measured, not guessed: a bounded sample of a
block's queries is compared with all vectors of the shard, and the count is the
one by which the wanted share of their true neighbours has arrived. Clustered
vectors need few; vectors without any structure need a good part of a shard.

The forest is kept in shards of bounded size: a task builds its shard's sorted
arrays and answers a block of queries on them; a query's nearest of all shards
are merged. So a task's memory is that of one shard and one block, whatever the
table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docmill.llm.common import cut, groups
from docmill.llm.embedding_dedup import valid

#: Bits of a hash string.
BITS = 32
#: Numbers in the vectors of a shard and in the queries of a block, about; and vectors for which a shard of its own pays while tasks are idle.
SHARD, QUERIES, LEAST = 1 << 21, 1 << 20, 4096
#: Queries of a block by which the number of candidates is measured.
MEASURED = 64


class Forest:
    """Sorted hash strings of one shard's vectors (one length), for each tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, center: np.ndarray, trees: int, seed: int):
        self.x, self.ids, self.center = x, ids, center
        self.planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((trees, x.shape[1] + 1, BITS))
        self.order, self.sorted = [], []
        moved = x - center
        norm = np.linalg.norm(moved, axis=1)
        longest = max(norm.max(), 1e-300)
        moved = np.column_stack([moved / longest, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))])
        for planes in self.planes:
            h = self.strings(moved, planes)
            o = np.argsort(h, kind="stable").astype(np.int32)
            self.order.append(o)
            self.sorted.append(h[o])

    def strings(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """The strings of vectors in one tree, first bit highest."""
        bits = x @ planes > 0
        return (bits.astype(np.uint64) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(1)

    def runs(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each length 0 to BITS, tree and query: where the run of strings that share the query's prefix begins and ends."""
        q = np.column_stack([q / np.abs(q).max(1, keepdims=True), np.zeros(len(q))])
        lo = np.empty((BITS + 1, len(self.planes), len(q)), np.int32)
        hi = np.empty_like(lo)
        for t, planes in enumerate(self.planes):
            h = self.strings(q, planes)
            for n in range(BITS + 1):
                low = (h >> np.uint64(BITS - n)) << np.uint64(BITS - n)
                lo[n, t] = np.searchsorted(self.sorted[t], low)
                hi[n, t] = np.searchsorted(self.sorted[t], low + (np.uint64(1) << np.uint64(BITS - n)))
        return lo, hi

    def ascent(self, lo: np.ndarray, hi: np.ndarray, seen: np.ndarray, enough: int) -> Iterator[None]:
        """Marks one query's candidates in ``seen``, all trees ascending together; a step is one tree at one length (those before ``enough`` can be reached: one step)."""
        total = (hi - lo).sum(1)
        n = max(np.flatnonzero(total >= enough).tolist() or [0])  # runs of shorter prefixes hold those of longer ones
        if n < BITS:
            for t in range(len(self.planes)):
                seen[self.order[t][lo[n + 1, t] : hi[n + 1, t]]] = True
        for length in range(n, -1, -1):
            for t in range(len(self.planes)):
                seen[self.order[t][lo[length, t] : hi[length, t]]] = True
                yield

    def enough(self, q: np.ndarray, own: np.ndarray, k: int, recall: float) -> int:
        """Candidates by which that share of the k nearest of a sample of the queries has arrived."""
        some = np.unique(np.linspace(0, len(q) - 1, min(MEASURED, len(q))).astype(int))
        part, arrived = q[some], []
        lo, hi = self.runs(part)
        score = part @ self.x.T
        score[own[some][:, None] == self.ids[None, :]] = -np.inf
        for i in range(len(some)):
            wanted = np.argsort(-score[i], kind="stable")[: min(k, np.count_nonzero(score[i] > -np.inf))]
            seen, missing = np.zeros(len(self.ids), bool), wanted
            for _ in self.ascent(lo[:, :, i], hi[:, :, i], seen, 1):
                here = seen[missing]
                if here.any():
                    arrived += [np.count_nonzero(seen)] * int(here.sum())
                    missing = missing[~here]
                if not len(missing):
                    break
        return int(np.quantile(arrived, recall, method="higher")) if arrived else len(self.ids)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, recall: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query: its number, the ids of its k nearest candidates (own id left out), and their inner products."""
        candidates = min(len(self.ids), max(4 * k, self.enough(q, own, k, recall)))
        for start in range(0, len(q), 256):
            part = q[start : start + 256]
            lo, hi = self.runs(part)
            for i in range(len(part)):
                seen = np.zeros(len(self.ids), bool)
                for _ in self.ascent(lo[:, :, i], hi[:, :, i], seen, candidates):
                    if np.count_nonzero(seen) >= candidates:
                        break
                at = np.flatnonzero(seen)
                at = at[self.ids[at] != own[start + i]]
                score = self.x[at] @ part[i]
                if len(at) > k:
                    cutoff = np.partition(score, len(at) - k)[len(at) - k]
                    at, score = at[score >= cutoff], score[score >= cutoff]
                    best = np.lexsort((self.ids[at], -score))[:k]
                    at, score = at[best], score[best]
                yield start + i, self.ids[at], score


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.97, trees: int = 48, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11, fit_rows: int = 10_000) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every query among all other rows.

    is_query is a condition on the id. A shard gives a query as many candidates
    as it took to find the share ``recall`` of the neighbours of at most MEASURED
    of the block's queries, 4 k at least. The centre that is subtracted before
    hashing is the mean of about fit_rows vectors chosen by a hash of the id
    (the documented bound); every row is indexed. Vectors that are null, zero
    or hold null or non-finite components take no part; vectors of another
    length than the query's are no candidates. Rows with one id are one
    candidate each, but a query leaves out all rows with its own id; several
    query rows of one id share its k places. Rows without an id are neither. Ties
    go to the smaller id. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(valid("v") & F.col("id").isNotNull())
    sized = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(is_query(F.col("id")).cast("long")).alias("q"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = {r.d: (max(1, -(-r.n * r.d // SHARD), min(parts, r.n // LEAST)), max(1, -(-r.q * r.d // QUERIES)), r.n) for r in sized.collect()}
    out = "query_id long, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centers = {}
    for d, (_, _, n) in sizes.items():
        at = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
        picked = rows.where((F.size("v") == d) & (at < min(1.0, fit_rows / n)))
        got = picked.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
        centers[d] = np.array([r.m for r in got]) if got else np.zeros(d)
    lookup = F.create_map(*[F.lit(x) for d, (s, b, _) in sizes.items() for x in (d, s * 1_000_000 + b)])
    packed = rows.withColumn("d", F.size("v")).withColumn("both", lookup[F.col("d")]).where("both is not null")
    packed = packed.withColumn("shards", F.expr("int(both div 1000000)")).withColumn("blocks", F.expr("int(both % 1000000)"))
    one = F.lit(0)
    base = packed.select("d", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("s"), F.explode(F.sequence(one, F.col("blocks") - 1)).alias("b"), F.lit(0).alias("kind"), "id", "v")
    asked = packed.where(is_query(F.col("id"))).select("d", F.explode(F.sequence(one, F.col("shards") - 1)).alias("s"), F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.col("blocks")).cast("int").alias("b"), F.lit(1).alias("kind"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            kind, ids = g.column(3).to_numpy(), g.column(4).to_numpy()
            if not kind.any() or kind.all():
                continue
            d = g.column(0)[0].as_py()
            x = g.column(5).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            forest = Forest(x[kind == 0], ids[kind == 0], centers[d], trees, seed)
            q = ids[kind == 1]
            found = list(forest.search(x[kind == 1], q, k, recall))
            yield pa.record_batch([pa.array(np.concatenate([np.full(len(i), q[n]) for n, i, _ in found]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

    n = max(parts, sum(s * b for s, b, _ in sizes.values()))
    dealt = base.unionByName(asked).repartition(n, "d", "s", "b").sortWithinPartitions("d", "s", "b", "kind", "id")
    found = cut(dealt.mapInArrow(run, out))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
