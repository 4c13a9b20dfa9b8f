"""Marking, reprocessing, metadata, reranking, chat lists and the breaker on edge cases."""

import pytest
from pyspark.sql import functions as F

from docmill.operators import documents as D, ingest as I, retrieval as V


def test_marks(spark):
    docs = spark.createDataFrame([(1, "pending", "old", 5), (2, "pending", "old", 5), (3, "pending", "old", 5), (4, "pending", "old", 5)], "doc_id long, status string, error_message string, chunks_count long")
    outcomes = spark.createDataFrame([(1, "failed", None, None, None), (1, "completed", None, 2, None), (2, "failed", 9, None, "x"), (3, "processing", 9, 9, "y"), (9, "failed", 1, 1, "z")], "doc_id long, outcome string, chunks_count long, embeddings_count long, error string")
    got = {r.doc_id: (r.status, r.chunks_count, r.embeddings_count, r.error_message, r.processing_started_at is not None, r.processing_completed_at is not None) for r in D.mark(docs, outcomes, "2024-01-01 00:00:00").collect()}
    assert got == {1: ("published", 5, 2, None, False, True), 2: ("failed", 5, None, "x", False, True), 3: ("processing", 5, None, None, True, False), 4: ("pending", 5, None, "old", False, False)}
    assert D.mark(docs.limit(0), outcomes, "2024-01-01 00:00:00").count() == 0


def test_metadata(spark):
    docs = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, None), (3, {"a": "1"})], "doc_id long, metadata map<string,string>")
    changes = spark.createDataFrame([(1, {"a": None, "c": "3"}), (2, {"x": "y"}), (8, {"q": "r"})], "doc_id long, metadata map<string,string>")
    assert {r.doc_id: r.metadata for r in D.update_metadata(docs, changes).collect()} == {1: {"b": "2", "c": "3"}, 2: {"x": "y"}, 3: {"a": "1"}}


def test_rerank_puts_refused_pairs_last(spark):
    hits = spark.createDataFrame([(1, i, "q", t) for i, t in enumerate(["a", "bad", "ccc", "aaa"])] + [(2, 7, "q", "bad")], "question_id long, chunk_id long, query string, text string").coalesce(1)

    def score(pairs):
        if any(t == "bad" for _, t in pairs):
            raise I.ServiceError(400, "refused")
        return [len(t) for _, t in pairs]

    got = sorted((r.question_id, r.rank, r.chunk_id) for r in V.rerank_scored(hits, score, 4, wait=0.0).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (1, 3, 0), (1, 4, 1), (2, 1, 7)]


def test_message_lists(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(7)] + [(2, 0, "user", None)], "c long, turn long, role string, text string")
    got = {r.c: [(m.role, m.content) for m in r.messages] for r in I.message_lists(turns, "c", "turn", "role", "text", 3, "sys").collect()}
    assert got == {1: [("system", "sys"), ("user", "t4"), ("assistant", "t5"), ("user", "t6")], 2: [("system", "sys"), ("user", None)]}
    rows = I.chat_pieces(I.message_lists(turns, "c", "turn", "role", "text"), "messages", lambda chats: [None if m[-1]["content"] is None else ["a", "b"] for m in chats])
    assert sorted((r.c, r.piece, r.text, r.result, r.error) for r in rows.collect() if r.c == 1) == [(1, 0, "a", "ab", None), (1, 1, "b", "ab", None)]
    assert [(r.piece, r.result, r.error) for r in rows.where("c = 2").collect()] == [(None, None, "no result")]


def test_a_service_that_is_down_is_not_asked_for_each_value(spark):
    calls = spark.sparkContext.accumulator(0)

    def down(values):
        calls.add(1)
        raise I.ServiceError(503, "down")

    rows = I.called(spark.range(50).coalesce(1), "id", down, batch=25, wait=0.0).collect()
    assert {r.error for r in rows} == {"503 down"} and calls.value == 2 * 3  # two batches of three tries
    with pytest.raises(Exception, match="no such thing"):
        I.called(spark.range(2), "id", lambda v: _broken(), wait=0.0).collect()
    assert I.called(spark.range(3), "id", lambda v: ["x"] * len(v)).where(F.col("result") == "x").count() == 3


def _broken():
    raise KeyError("no such thing")
