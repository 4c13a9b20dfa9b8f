"""Status and metadata of documents: outcomes of processing, reprocessing by who may write, merged metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def mark(docs: DataFrame, outcomes: DataFrame, now: str, key: str = "doc_id") -> DataFrame:
    """All documents, those with an outcome ``(key, outcome, chunks_count, embeddings_count, error)`` marked.

    processing sets the time of its start; completed publishes the document with
    its counts (those that are null stay); failed keeps the error, ``Unknown
    error`` without one. Outcomes of keys that aren't there change nothing, of
    several of one document the last one counts (failed, processing, completed).
    """
    o = outcomes.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct("outcome", "chunks_count", "embeddings_count", "error"), F.expr("array_position(array('failed', 'processing', 'completed'), outcome)")).alias("_o"))
    at, kind = F.lit(now).cast("timestamp_ntz"), F.col("_o.outcome")
    held = lambda name, kind_: F.col(name) if name in docs.columns else F.lit(None).cast(kind_)
    over = kind.isin("completed", "failed")
    return docs.join(o, F.col(key) == F.col("_k"), "left").withColumns({
        "status": F.when(kind == "completed", "published").otherwise(F.coalesce(kind, "status")),
        "processing_started_at": F.when(kind == "processing", at).otherwise(held("processing_started_at", "timestamp_ntz")),
        "processing_completed_at": F.when(over, at).otherwise(held("processing_completed_at", "timestamp_ntz")),
        "chunks_count": F.when(kind == "completed", F.coalesce("_o.chunks_count", held("chunks_count", "long"))).otherwise(held("chunks_count", "long")),
        "embeddings_count": F.when(kind == "completed", F.coalesce("_o.embeddings_count", held("embeddings_count", "long"))).otherwise(held("embeddings_count", "long")),
        "error_message": F.when(kind == "failed", F.coalesce("_o.error", F.lit("Unknown error"))).when(kind.isNull(), held("error_message", "string")),
    }).drop("_k", "_o")


def judged(requests: DataFrame, docs: DataFrame, writable: DataFrame, key: str = "doc_id") -> DataFrame:
    """Requests ``(key, account_id, ..)`` with ``refused``: why one isn't done, null if it is; ``writable`` are (account_id, key) pairs."""
    known = docs.select(F.col(key), F.lit(True).alias("_known")).distinct()
    may = writable.select("account_id", key).distinct().withColumn("_may", F.lit(True))
    rows = requests.join(known, key, "left").join(may, ["account_id", key], "left")
    return rows.withColumn("refused", F.when(F.col("_known").isNull(), "not found").when(F.col("_may").isNull(), "no write permission")).drop("_known", "_may")


def reprocess(docs: DataFrame, requests: DataFrame, writable: DataFrame, key: str = "doc_id") -> DataFrame:
    """All documents; those of a request that isn't refused are processing again, with the request's ``chunking_strategy`` and ``embedding_model`` where given (the largest, of several)."""
    done = judged(requests, docs, writable, key).where("refused is null").groupBy(F.col(key).alias("_k")).agg(F.max("chunking_strategy").alias("_s"), F.max("embedding_model").alias("_m"))
    hit = F.col("_k").isNotNull()
    out = docs.join(done, F.col(key) == F.col("_k"), "left")
    return out.withColumns({"status": F.when(hit, "processing").otherwise(F.col("status")), "chunking_strategy": F.coalesce("_s", "chunking_strategy"), "embedding_model": F.coalesce("_m", "embedding_model")}).drop("_k", "_s", "_m")


def update_metadata(docs: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """All documents with the changes' metadata (maps; one change a key) merged into theirs: new values win, a null value takes its key out."""
    empty = F.create_map().cast("map<string,string>")
    c = changes.select(F.col(key).alias("_k"), F.col("metadata").alias("_m"))
    old, new = F.coalesce("metadata", empty), F.coalesce("_m", empty)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    merged = F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull()))
    return docs.join(c, F.col(key) == F.col("_k"), "left").withColumn("metadata", F.when(F.col("_k").isNull(), F.col("metadata")).otherwise(merged)).drop("_k", "_m")
