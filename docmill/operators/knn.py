"""Exact nearest chunks of many questions at once, each among what its own account may see.

Questions and chunks meet in blocks: a task holds one block of questions and
streams one group of chunks by, a matrix product for each Arrow batch, and keeps
the k best of each question so far. Access is below the ranking: a chunk counts
for a question only if the account holds one of the keys of the chunk's document
and none of those it is denied to. Documents with equal keys are one class, which
is decided for a tile of questions at once, by a bit for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

#: Bytes of vectors in a block of questions, and chunks of a group, from which on there is one more.
QUESTION_BYTES, CHUNKS = 64 << 20, 2_000_000
#: Questions and chunks of one matrix product, and pairs whose exact scores are taken at once.
TILE, STRIP, PAIRS = 512, 2048, 1 << 16


def _unit(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """Vectors as rows of length 1; rows of NaN for those that are null, zero, of another dimension, or hold null or non-finite numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = np.full((len(column), dimension), np.nan)
    good = n == dimension
    if good.any():
        out[good] = column.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    norm = np.sqrt((out * out).sum(1))
    out[~(np.isfinite(norm) & (norm > 0))] = np.nan
    return out / np.where(norm > 0, norm, 1)[:, None]


class _Tile:
    """Some questions of a block with the best chunks of each so far."""

    def __init__(self, at: np.ndarray, vectors: np.ndarray, keys: np.ndarray, owners: np.ndarray, least: float, margin: float):
        """keys: numbers of the questions' keys, owners: which of the tile's questions holds each."""
        self.at, self.vectors, self.rough, self.margin, self.least = at, vectors, vectors.astype(np.float32), margin, least
        self.keys, place = np.unique(keys, return_inverse=True)
        held = np.zeros((len(self.keys) + 1, len(at)), bool)  # the last row is of keys that no question has
        held[place, owners] = True
        self.held = np.packbits(held, axis=1)
        self.of, self.score, self.chunks = np.zeros(0, np.int64), np.zeros(0), None
        self.bar = np.full(len(at), least - margin, np.float32)

    def any_of(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of bits for each class of documents: which questions hold one of its keys. No class is without keys."""
        place = np.searchsorted(self.keys, keys)
        none = len(self.keys)
        place[place < none] = np.where(self.keys[place[place < none]] == keys[place < none], place[place < none], none)
        return np.bitwise_or.reduceat(self.held[place], starts, axis=0)

    def add(self, ids: pa.Array, vectors: np.ndarray, rough: np.ndarray, kind: np.ndarray, opened: tuple, shut: tuple, k: int) -> None:
        """Compares chunks, of which only those that pass a question's bar by the rough product are looked at."""
        seen = np.unpackbits(self.any_of(*opened) & ~self.any_of(*shut), axis=1, count=len(self.at)).view(bool)
        for lo in range(0, len(vectors), STRIP):
            part = slice(lo, lo + STRIP)
            self._strip(ids[part], vectors[part], rough[part], kind[part], seen, k)

    def _strip(self, ids: pa.Array, vectors: np.ndarray, rough: np.ndarray, kind: np.ndarray, seen: np.ndarray, k: int) -> None:
        s = self.rough @ rough.T
        over = s > self.bar[:, None]
        many = np.flatnonzero(np.count_nonzero(over, axis=1) > max(64, 4 * k)) if s.shape[1] > k else ()
        if len(many):
            part = np.where(seen[:, many][kind].T, s[many], -np.inf)
            bar = np.partition(part, -k, axis=1)[:, -k] - 2 * self.margin
            self.bar[many] = np.maximum(self.bar[many], bar)
            over[many] = part > self.bar[many][:, None]
        i, j = np.divmod(np.flatnonzero(over), s.shape[1])
        good = seen[kind[j], i]
        i, j = i[good], j[good]
        if not len(i):
            return
        exact = np.concatenate([(self.vectors[i[lo : lo + PAIRS]] * vectors[j[lo : lo + PAIRS]]).sum(1) for lo in range(0, len(i), PAIRS)])  # by rows: equal vectors have equal scores
        good = exact >= self.least
        new = ids.take(pa.array(j[good]))
        chunks = new if self.chunks is None else pa.concat_arrays([self.chunks, new])
        of, score = np.concatenate([self.of, i[good]]), np.concatenate([self.score, exact[good]])
        place = pc.rank(chunks, tiebreaker="min").to_numpy().astype(np.int64)
        order = np.lexsort((place, -score, of))
        nth = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        keep = order[nth < k]
        last = order[nth == k - 1]
        self.of, self.score, self.chunks = of[keep], score[keep], chunks.take(pa.array(keep))
        self.bar[of[last]] = np.maximum(self.bar[of[last]], score[last] - self.margin)


class _Block:
    """A block's questions in tiles. What it holds besides them grows with neither the classes of documents nor the chunks."""

    def __init__(self, rows: pa.Table, dimension: int, k: int, threshold: float | None):
        self.ids, self.k, self.dimension = rows.column("question_id").combine_chunks(), k, dimension
        vectors, least = _unit(rows.column("question"), dimension), -np.inf if threshold is None else threshold
        margin = (dimension + 8) * 2.0**-24 * 2  # beyond what a product in single precision can be wrong by
        keys = rows.column("keys").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(keys.flatten(), null_encoding="encode")
        self.known = {x: n for n, x in enumerate(coded.dictionary.to_pylist())}
        codes, ends = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)
        self.tiles, good = [], np.flatnonzero(~np.isnan(vectors[:, 0]))
        for lo in range(0, len(good), TILE):
            at = good[lo : lo + TILE]
            mine = np.concatenate([codes[ends[x] - sizes[x] : ends[x]] for x in at])
            self.tiles.append(_Tile(at, vectors[at], mine, np.repeat(np.arange(len(at)), sizes[at]), least, margin))

    def _numbers(self, lists: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the keys of each list that questions hold, each list begun by one of none, and where each begins."""
        found = [[-1, *(self.known[x] for x in keys if x in self.known)] for keys in lists]
        return np.array([n for x in found for n in x]), np.cumsum([0, *map(len, found[:-1])])

    def add(self, rows: pa.Table) -> None:
        """Compares a batch of chunks; of those with equal vectors and keys the k first are enough."""
        vectors, ids = _unit(rows.column("vector"), self.dimension), rows.column("chunk_id").combine_chunks()
        both = list(zip(rows.column("keys").to_pylist(), rows.column("denied").to_pylist()))
        classes: dict = {}
        kind = np.array([classes.setdefault((tuple(a or ()), tuple(b or ())), len(classes)) for a, b in both])
        good = np.flatnonzero(~np.isnan(vectors[:, 0]))
        if not len(good):
            return
        same = np.unique(np.ascontiguousarray(vectors[good]).view(f"V{8 * self.dimension}").ravel(), return_inverse=True)[1] * len(classes) + kind[good]
        order = np.lexsort((pc.rank(ids, tiebreaker="min").to_numpy().astype(np.int64)[good], same))
        nth = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        good = np.sort(good[order[nth < self.k]])
        vectors, kind, ids = vectors[good], kind[good], ids.take(pa.array(good))
        opened, shut, rough = self._numbers([a for a, _ in classes]), self._numbers([b for _, b in classes]), vectors.astype(np.float32)
        for tile in self.tiles:
            tile.add(ids, vectors, rough, kind, opened, shut, self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The best of all questions, tile by tile."""
        for tile in self.tiles:
            if len(tile.of):
                yield pa.record_batch([self.ids.take(pa.array(tile.at[tile.of])), tile.chunks, pa.array(tile.score)], ["question_id", "chunk_id", "score"])


def nearest(questions: DataFrame, chunks: DataFrame, k: int = 5, dimension: int = 64, threshold: float | None = None) -> DataFrame:
    """``(question_id, rank, chunk_id, score)``: the k visible chunks of the largest cosine for each question, ties to the smaller chunk.

    Questions are ``(question_id, vector, keys)``, chunks ``(chunk_id, vector,
    keys, denied)``; access.account_keys and access.document_keys make the keys.
    Scores are exact cosines in double precision, with a threshold those of at
    least that. Vectors that are null, zero, of another dimension, or hold null
    or non-finite numbers take no part. Question ids are unique; chunk ids may
    be any type that sorts.

    A question moves once for each group of chunks and a chunk once for each
    block of questions; there are as few of both as memory and cores allow. No
    cross join: every row names the pair it belongs to.
    """
    spark = questions.sparkSession
    n_questions, n_chunks = questions.count(), chunks.count()
    blocks = max(1, -(-n_questions * dimension * 8 // QUESTION_BYTES))
    groups = max(1, -(-n_chunks // CHUNKS), min(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-n_chunks // 4096)))
    strings = lambda c: F.col(c).cast("array<string>")
    numbers = lambda kind: F.col("vector").cast(kind)
    of = "array<float>" if chunks.schema["vector"].dataType == T.ArrayType(T.FloatType(), chunks.schema["vector"].dataType.containsNull) else "array<double>"
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = questions.select("question_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), numbers("array<double>").alias("question"), F.lit(None).cast(of).alias("vector"), strings("keys").alias("keys"), F.lit(None).cast("array<string>").alias("denied"), F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("grp"))
    held = chunks.select(F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"), "chunk_id", F.lit(None).cast("array<double>").alias("question"), numbers(of).alias("vector"), strings("keys").alias("keys"), strings("denied").alias("denied"), every(blocks).alias("block"), F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int").alias("grp"))
    asked, held = asked.withColumn("chunk", F.lit(False)), held.withColumn("chunk", F.lit(True))
    dealt = asked.unionByName(held).repartitionById(blocks * groups, F.col("block") * groups + F.col("grp")).sortWithinPartitions("block", "grp", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pair, waiting = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None:
                yield from block.rows()

        for b in batches:
            if not b.num_rows:
                continue
            pairs = np.stack([b.column("block").to_numpy(), b.column("grp").to_numpy(), b.column("chunk").to_numpy(zero_copy_only=False)])
            edges = [0, *(np.flatnonzero((pairs[:, 1:] != pairs[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                now, part = tuple(pairs[:2, lo]), b.slice(lo, hi - lo)
                if now != pair:
                    yield from done()
                    block, pair, waiting = None, now, []
                if not pairs[2, lo]:
                    waiting.append(part)
                elif waiting or block is not None:
                    if block is None:
                        block, waiting = _Block(pa.Table.from_batches(waiting), dimension, k, threshold), []
                    block.add(pa.Table.from_batches([part]))
        yield from done()

    schema = T.StructType([questions.schema["question_id"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
    return dealt.mapInArrow(run, schema).withColumn("rank", place).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "score")


#: Text in place of a context without hits.
NO_CONTEXT = "No related documents were found."


def answers(questions: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """``(question_id, context, sources)``: each question's hits as lines ``- text`` in rank order (or the placeholder), and their distinct documents.

    hits are those of nearest, texts ``(chunk_id, doc_id, text)``; a question has at most its k hits.
    """
    lines = F.array_sort(F.collect_list(F.struct("rank", "text")))
    whole = hits.join(texts, "chunk_id").groupBy("question_id").agg(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x.text)), "\n").alias("context"), F.array_sort(F.collect_set("doc_id")).alias("sources"))
    none = F.array().cast(whole.schema["sources"].dataType)
    return questions.select("question_id").join(whole, "question_id", "left").select("question_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"), F.coalesce("sources", none).alias("sources"))
