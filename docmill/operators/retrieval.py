"""Retrieval: exact cosine top-k with filters below the ranking, full text, BM25, fusion, and context assembly."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from docmill.operators.lineage import cut


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))


def scored(chunks: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """All chunks with ``score``, the cosine to the one query row's vector (a one-row broadcast)."""
    q = F.broadcast(query.select(F.col(vector).alias("_q")).limit(1))
    return chunks.crossJoin(q).withColumn("score", cosine(F.col(vector), F.col("_q"))).drop("_q")


def top_k(chunks: DataFrame, query: DataFrame, k: int = 5, threshold: float | None = None, where: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """The k nearest chunks of those that meet the filter, best first, ties by key; the filter is below the ranking."""
    rows = scored(chunks if where is None else chunks.where(where), query)
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), key).limit(k)


def permitted_top_k(chunks: DataFrame, query: DataFrame, documents: DataFrame, k: int = 5, threshold: float | None = None) -> DataFrame:
    """top_k over the chunks of accessible documents only: the semi-join is below the ranking, never after it."""
    return top_k(chunks.join(documents.select("doc_id"), "doc_id", "left_semi"), query, k, threshold)


def two_stage(summaries: DataFrame, details: DataFrame, query: DataFrame, k_summaries: int = 3, k_details: int = 4) -> DataFrame:
    """The best details among the children of the best summaries (details have ``parent_id``)."""
    best = top_k(summaries, query, k_summaries).select(F.col("chunk_id").alias("parent_id"))
    return top_k(details.join(best, "parent_id", "left_semi"), query, k_details)


def bubble_up(chunks: DataFrame, query: DataFrame, k: int = 3, parent: str = "doc_id") -> DataFrame:
    """The first k parents of the best 2 k details, each with its details in rank order."""
    hits = top_k(chunks, query, 2 * k)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id")))
    grouped = hits.groupBy(parent).agg(F.transform(order, lambda x: x.chunk_id).alias("details"), F.max("score").alias("best"), F.min("chunk_id").alias("_c"))
    return grouped.orderBy(F.desc("best"), "_c").limit(k).drop("_c")


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings ``(id, term, tf)`` of lower-case words of ASCII letters and digits."""
    words = F.filter(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"), lambda w: w != "")
    return docs.select(id_col, F.explode(words).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def _times(low: Column, term: str) -> Column:
    """How often a text in lower case holds the term as a word; a plain search settles most texts that don't."""
    term = term.lower()
    if not re.fullmatch("[a-z0-9]+", term):
        return F.lit(0)
    return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))).otherwise(0)


def match_all(docs: DataFrame, id_col: str, text_col: str, query: list[str]) -> DataFrame:
    """Ids of documents with all terms: one filter on the words, no shuffle."""
    hit = F.lit(True)
    for q in query:
        hit = hit & (_times(F.lower(F.col(text_col)), q) > 0)
    return docs.where(hit).select(id_col)


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(id, score)`` of documents with a query term: BM25 with ln(1 + (N - n + 0.5) / (n + 0.5)).

    Only the query's terms are counted, inside each row and in one pass over the
    texts, whose counts are checkpointed; statistics are one aggregate of as many
    numbers, joined back as one row.
    """
    low = F.lower(F.col(text_col))
    rows = docs.where(low.isNotNull()).select(id_col, F.regexp_count(low, F.lit("[a-z0-9]+")).cast("double").alias("_n"), *[_times(low, q).cast("double").alias(f"_t{i}") for i, q in enumerate(query)])
    rows = cut(rows)
    stats = rows.agg(F.count("*").cast("double").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).cast("double").alias(f"_d{i}") for i in range(len(query))])
    joined = rows.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"_t{i}"), F.col(f"_d{i}")
        idf = F.ln(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    return joined.select(id_col, score.alias("score")).where("score > 0")


def fuse(rankings: list[DataFrame], id_col: str, top: int = 100, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of the first ``top`` rows of each ``(id, score)`` ranking."""
    parts = []
    for r in rankings:
        first = r.orderBy(F.desc("score"), id_col).limit(top)
        parts.append(first.select(id_col, (1.0 / (k + F.row_number().over(Window.orderBy(F.desc("score"), id_col)))).alias("part")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(id_col).agg(F.sum("part").alias("score"))


def rerank(rows: DataFrame, score: Column, k: int, key: str) -> DataFrame:
    """The k best by another score."""
    return rows.orderBy(score.desc(), key).limit(k)


def rerank_scored(hits: DataFrame, call: Callable[[list], list], k: int, query: str = "query", text: str = "text", by: str = "question_id", key: str = "chunk_id", **options) -> DataFrame:
    """The k hits of each question that an injected scorer of (query, text) pairs puts first, with ``rank`` and ``relevance``; ties by key.

    The scorer gets lists of pairs, a batch at a time, with retry; a pair that
    it refuses comes behind all others. For the hits of nearest: a question has
    few, so its ranking is a small group.
    """
    from docmill.operators.ingest import called

    pairs = hits.withColumn("_pair", F.array(query, text))
    rows = called(pairs, "_pair", lambda values: [float(x) for x in call([tuple(v) for v in values])], DoubleType(), **options)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("result"), key))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).withColumnRenamed("result", "relevance").drop("_pair", "error")


#: Text in place of a context without hits.
NO_CONTEXT = "No related documents were found."


def context(hits: DataFrame, text: str = "text") -> DataFrame:
    """One row: the hits as lines ``- text`` in rank order (or the placeholder), and their distinct documents."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c"), F.col(text).alias("t"))))
    lines = F.transform(ordered, lambda x: F.concat(F.lit("- "), x.t))
    whole = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_CONTEXT))
    return hits.agg(whole.alias("context"), F.array_sort(F.collect_set("doc_id")).alias("sources"))


def precision_at_k(hits: DataFrame, relevant: Column) -> DataFrame:
    """Share of relevant hits."""
    return hits.agg(F.avg(relevant.cast("double")).alias("precision"))
