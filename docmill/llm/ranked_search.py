"""Ranked lexical search: MaxScore in each shard of an inverted index.

A shard is a run of documents of one scan partition with a bounded number of
postings, so texts never move. Its postings are written once as rows of a
table. A search joins the rows of its terms with the items that ask for them,
and a task answers all items of a block in one shard: an item's terms are
ordered by the most that each can add in the shard; those that can't lift a
document above the k-th best score together are non-essential. Documents come
from the other, essential lists, and non-essential postings are probed, the
strongest first, only while a document can still qualify. As the k-th score
rises, terms become non-essential, until none is left or no document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from docmill.llm.common import cut, groups, slices
from docmill.llm.terms import merged, term_counts

#: Postings of a shard, from which on a new one begins.
POSTINGS = 4_000_000
#: Terms of a block of items, about: a shard's task answers a block at once.
BLOCK_TERMS = 50_000
#: Documents of the first step of a search through a shard; each next one has twice as many, up to the last number.
STEP, LAST_STEP = 512, 16_384
#: Fixed values of the ranking: scale of scores, saturation, and the length's share of it in hundredths.
SCALE, PER_TF, PER_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 8, 90


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = POSTINGS) -> None:
    """Writes the inverted index of all whole texts as a Parquet table.

    Rows are ``(shard, term, docs, total, places, counts, ids, lengths)``: for
    each term of a shard the documents that hold it (32-bit places in the shard,
    in order, and occurrences) with their number and sum, and one row of a null
    term with the documents' ids, ascending, and lengths in terms, the number of
    those that have a term and the sum of lengths. Null texts have no term;
    repeated rows are documents of their own; other columns are not read. One
    narrow pass; memory follows ``most`` and the longest text.
    """
    kind = docs.schema[id_col].dataType

    def shard(number: int, held: list, ids: list) -> Iterator[pa.RecordBatch]:
        every = pa.concat_arrays(ids)
        order = pc.sort_indices(every).to_numpy()  # nulls last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows, codes, counts, terms = merged(held)
        rows = place[rows]
        lengths = np.bincount(rows, counts, len(order)).astype("<i8")
        by = np.lexsort((rows, codes))
        rows, codes, counts = rows[by].astype("<u4"), codes[by], counts[by].astype("<u4")
        n, total = np.bincount(codes, minlength=len(terms)), np.bincount(codes, counts, len(terms)).astype(np.int64)
        ends = pa.py_buffer(np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int32))
        packed = [pa.Array.from_buffers(pa.binary(), len(terms), [None, ends, pa.py_buffer(x.tobytes())]) for x in (rows, counts)]
        none = pa.nulls
        listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), every.take(pa.array(order)))
        names = ["shard", "term", "docs", "total", "places", "counts", "ids", "lengths"]
        yield pa.record_batch([pa.array([number]), none(1, pa.string()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), none(1, pa.binary()), none(1, pa.binary()), listed, pa.array([lengths.tobytes()], pa.binary())], names)
        for lo in range(0, len(terms), 10_000):
            part = [x.slice(lo, 10_000) for x in (terms, pa.array(n), pa.array(total), *packed)]
            k = len(part[0])
            yield pa.record_batch([pa.array(np.full(k, number)), *part, none(k, listed.type), none(k, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, ids, rows, size = [], [], 0, 0
        for b in slices(batches, "t"):
            r, c, n, terms = term_counts(b.column(1), True)
            held.append((r + rows, c, n, terms))
            ids.append(b.column(0))
            rows += b.num_rows
            size += len(r)
            if size >= most:
                yield from shard(number, held, ids)
                held, ids, rows, size, number = [], [], 0, 0, number + 1
        if rows:
            yield from shard(number, held, ids)

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("total", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.BinaryType())])
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows.mapInArrow(run, schema).write.parquet(path)


def asked_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, term)``: the distinct terms of each item; the texts of one id (a null one, too) make one item."""
    kind = items.schema[item_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            rows, codes, _, terms = term_counts(b.column(1), True)
            yield pa.record_batch([b.column(0).take(pa.array(rows)), terms.take(pa.array(codes))], ["item", "term"])

    rows = items.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    schema = T.StructType([T.StructField("item", kind), T.StructField("term", T.StringType())])
    return rows.mapInArrow(run, schema).distinct()


def best(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best documents of a shard, best first, ties to the lower place, by MaxScore; and how many postings were read.

    A list is a term's places, ascending, and what it adds to each document's
    score (integers of 0 or more). Only scores above 0 count.
    """
    bounds = np.array([int(x.max()) for _, x in lists], np.int64)
    order = np.argsort(bounds, kind="stable")
    lists, reach = [lists[i] for i in order], np.cumsum(bounds[order])
    at = [0] * len(lists)
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, lo, step, read = 0, 0, STEP, 0
    while lo < docs:
        hi = min(docs, lo + step)
        first = int(np.searchsorted(reach, least, "right"))  # the lists before it lift no document above the k-th score
        if first == len(lists):
            break
        total = np.zeros(hi - lo, np.int64)
        for i in range(first, len(lists)):
            p, x = lists[i]
            begin = at[i] + int(np.searchsorted(p[at[i] :], lo)) if at[i] < len(p) and p[at[i]] < lo else at[i]
            end = begin + int(np.searchsorted(p[begin:], hi))
            total[p[begin:end] - lo] += x[begin:end]
            at[i] = end
            read += end - begin
        found = np.flatnonzero(total)
        for i in range(first - 1, -1, -1):
            found = found[total[found] + reach[i] > least]
            if not len(found):
                break
            p, x = lists[i]
            where = np.minimum(np.searchsorted(p, found + lo), len(p) - 1)
            hit = p[where] == found + lo
            total[found[hit]] += x[where[hit]]
            read += int(hit.sum())
        found = found[total[found] > least]
        if len(found):
            places, scores = np.concatenate([places, found + lo]), np.concatenate([scores, total[found]])
            top = np.lexsort((places, -scores))[:k]
            places, scores = places[top], scores[top]
            if len(scores) == k:
                least = int(scores[-1])
        lo, step = hi, min(2 * step, LAST_STEP)
    return places, scores, read


def search(index: DataFrame, asked: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item, rank, id, score)``: the k best documents of the index for each item of asked_terms, equal scores by ascending id (null last).

    The weight of a term is floor(1000 * ln((2 N + 2) / (2 df + 1))); a
    document's score sums weight * (SCALE * tf div (1000 * tf + 8 * m)) over the
    item's terms, with m = 10 + 90 * n * N div L. The statistics are sums over
    the whole index. Terms move with the items that ask for them, in blocks of
    items; a task holds one shard's postings of one block. Each task's k best
    of an item are ranked, partly before they move. An item without a term of
    any document has no row; an empty index or no items give none.
    """
    asked = cut(asked)
    one = index.where(F.col("term").isNull()).agg(F.sum("docs").alias("docs"), F.sum("total").alias("terms")).first()
    total, terms_in_all = one.docs or 0, one.terms or 0
    wanted = asked.select("term").distinct()
    held = index.where(F.col("term").isNotNull()).select("term", "docs").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(float(total)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    weighted = asked.join(held, "term").withColumn("weight", weight).where(F.col("weight") > 0)
    blocks = max(1, -(-asked.count() // block_terms))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    packed = weighted.groupBy(block, "term", "weight").agg(F.collect_list(F.struct("item")).alias("items"))
    lists = index.where(F.col("term").isNotNull()).select("shard", "term", "places", "counts").join(packed, "term")
    lists = lists.select("shard", "block", "weight", "places", "counts", "items", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"), F.lit(None).cast("binary").alias("lengths"))
    whole = index.where(F.col("term").isNull()).select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("counts"), F.lit(None).cast(lists.schema["items"].dataType).alias("items"), "ids", "lengths")
    dealt = lists.unionByName(whole).repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("weight").isNotNull())
    item_kind, id_kind = asked.schema["item"].dataType, index.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2):
            if g.num_rows < 2:
                continue
            weights, items = g.column("weight").to_pylist(), g.column("items").combine_chunks()
            n = np.frombuffer(g.column("lengths")[0].as_buffer(), "<i8")
            m = PER_LENGTH * (100 - LENGTH_SHARE + LENGTH_SHARE * n * total // terms_in_all)
            ids = g.column("ids").combine_chunks().flatten()
            lists = []
            for w, p, c in zip(weights[1:], g.column("places").to_pylist()[1:], g.column("counts").to_pylist()[1:]):
                places, tf = np.frombuffer(p, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)
                lists.append((places, w * (SCALE * tf // (PER_TF * tf + m[places]))))
            entries = items.slice(1)
            lengths = pc.list_value_length(entries).to_numpy(zero_copy_only=False)
            coded = entries.flatten().field(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(lists)), lengths)
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            got = [best([lists[j] for j in of[order[a:b]]], len(n), k)[:2] for a, b in zip(edges, edges[1:])]
            sizes = [len(p) for p, _ in got]
            at = np.repeat(np.arange(len(got)), sizes)
            places = np.concatenate([p for p, _ in got]).astype(np.int64)
            yield pa.record_batch([coded.dictionary.take(pa.array(at)), ids.take(pa.array(places)), pa.array(np.concatenate([s for _, s in got]).astype(np.int64))], ["item", "id", "score"])

    schema = T.StructType([T.StructField("item", item_kind), T.StructField("id", id_kind), T.StructField("score", T.LongType())])
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return dealt.mapInArrow(run, schema).withColumn("rank", place).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index that build_index wrote."""
    return spark.read.parquet(path)
