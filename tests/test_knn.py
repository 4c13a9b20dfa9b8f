"""Nearest chunks of many questions against brute force: access, ties, broken vectors, many blocks; and their plan."""

import math
import random

import pytest

from docmill.operators import access as A, knn


def _brute(questions, chunks, k, threshold=None):
    def good(v):
        return v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    out = []
    for q, v, keys in questions:
        found = []
        for c, e, opened, shut in chunks:
            if good(v) and good(e) and set(keys or ()) & set(opened or ()) and not set(keys or ()) & set(shut or ()):
                s = sum(a * b for a, b in zip(v, e)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in e))
                if threshold is None or s >= threshold:
                    found.append((-round(s, 9), c))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def _rows(r, n, m):
    vector = lambda: [r.randrange(-3000, 3000) / 64 for _ in range(4)]
    some = lambda *x: [y for y in x if r.random() < 0.4]
    questions = [(i, vector(), some("a", "b", "c", "d")) for i in range(n)]
    chunks = [(i, vector(), some("a", "b", "c"), some("c", "d")) for i in range(m)]
    questions += [(n, None, ["a"]), (n + 1, [0.0] * 4, ["a"]), (n + 2, [1.0, float("nan"), 0.0, 0.0], ["a"]), (n + 3, vector(), None), (n + 4, [1.0, 0.0, 0.0], ["a"])]
    chunks += [(m, None, ["a"], None), (m + 1, [1.0, None, 0.0, 0.0], ["a"], []), (m + 2, [0.0] * 4, ["a"], []), (m + 3, [1.0, 2.0], ["a"], []), (m + 4, vector(), None, None), (m + 5, [float("inf"), 0.0, 0.0, 0.0], ["a"], [])]
    return questions, chunks + [(m + 10 + i, [1.0, 1.0, 0.0, 2.0], ["a", "b"], None) for i in range(30)]


@pytest.mark.parametrize("blocks", [1, 5])
def test_equals_brute_force(spark, monkeypatch, blocks):
    questions, chunks = _rows(random.Random(blocks), 90, 400)
    if blocks > 1:
        monkeypatch.setattr(knn, "QUESTION_BYTES", 20 * 4 * 8)
        monkeypatch.setattr(knn, "CHUNKS", 50)
    q = spark.createDataFrame(questions, "question_id long, vector array<double>, keys array<string>")
    c = spark.createDataFrame(chunks, "chunk_id long, vector array<float>, keys array<string>, denied array<string>")
    for k, threshold in ((5, None), (3, 0.5), (500, None)):
        got = sorted((r.question_id, r.rank, r.chunk_id, round(r.score, 9)) for r in knn.nearest(q, c, k, 4, threshold).collect())
        assert [x[:3] for x in got] == [x[:3] for x in _brute(questions, chunks, k, threshold)]
    assert knn.nearest(q.limit(0), c, 5, 4).count() == 0 and knn.nearest(q, c.limit(0), 5, 4).count() == 0


def test_no_cross_join_and_no_python_above_the_ranking(spark):
    questions, chunks = _rows(random.Random(1), 5, 5)
    q = spark.createDataFrame(questions, "question_id long, vector array<double>, keys array<string>")
    c = spark.createDataFrame(chunks, "chunk_id string, vector array<float>, keys array<string>, denied array<string>")
    plan = knn.nearest(q, c, 5, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_keys_open_and_shut(spark):
    docs = spark.createDataFrame([(1, "company", None, 9), (2, "department", 3, 9), (3, "personal", 3, 7), (4, "personal", None, 9), (5, None, None, 9)], "doc_id long, access_scope string, department_id long, uploader_id long")
    acl = spark.createDataFrame([(4, "account", 7, "override", "read"), (1, "role", 2, "deny", "read"), (5, "role", 1, "override", "write"), (5, "role", 1, "inherit", "write")], "doc_id long, subject_type string, subject_id long, precedence string, permission string")
    accounts = spark.createDataFrame([(7, 3), (8, None), (10, 4)], "account_id long, department_id long")
    roles = spark.createDataFrame([(8, 1), (10, 2), (10, 1)], "account_id long, role_id long")
    held = {r.account_id: set(r["keys"]) for r in A.account_keys(accounts, roles).collect()}
    seen = {a: set() for a in held}
    for r in A.document_keys(docs, acl).collect():
        assert r["keys"] == sorted(set(r["keys"])) and r.denied == sorted(set(r.denied))
        for a, keys in held.items():
            if keys & set(r["keys"]) and not keys & set(r.denied):
                seen[a].add(r.doc_id)
    assert seen == {7: {1, 2, 3, 4}, 8: {1, 2, 5}, 10: {5}}


@pytest.mark.parametrize("seed", [1, 2])
def test_tiles_and_strips_equal_brute_force(spark, monkeypatch, seed):
    """Several tiles of questions and strips of chunks, many classes of documents, one vector in a third of the chunks."""
    questions, chunks = _rows(random.Random(seed), 120, 300)
    chunks = [(c, [1.0, 1.0, 0.0, 2.0] if v and c % 3 == 0 else v, a and [*a, f"own{c % 70}"], b) for c, v, a, b in chunks]
    questions = [(q, v, k and [*k, f"own{q % 90}"]) for q, v, k in questions]
    monkeypatch.setattr(knn, "TILE", 16)
    monkeypatch.setattr(knn, "STRIP", 40)
    monkeypatch.setattr(knn, "PAIRS", 50)
    q = spark.createDataFrame(questions, "question_id long, vector array<double>, keys array<string>")
    c = spark.createDataFrame(chunks, "chunk_id long, vector array<float>, keys array<string>, denied array<string>")
    for k, threshold in ((3, None), (5, 0.4)):
        got = sorted((r.question_id, r.rank, r.chunk_id) for r in knn.nearest(q, c, k, 4, threshold).collect())
        assert got == [x[:3] for x in _brute(questions, chunks, k, threshold)]


def test_memory_of_a_block_is_bounded():
    """20,000 questions meet 4,000 chunks, each of a class of its own: no table of questions by chunks or classes is made."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    vectors = lambda n: pa.array(list(r.normal(size=(n, 8)).astype(np.float64)), pa.list_(pa.float64()))
    asked = pa.table({"question_id": pa.array(range(20_000)), "question": vectors(20_000), "vector": vectors(20_000), "keys": pa.array([["company", f"u:{i % 500}"] for i in range(20_000)])})
    held = pa.table({"chunk_id": pa.array(range(4000)), "vector": vectors(4000), "keys": pa.array([[f"u:{i % 900}", f"r:{i}"] for i in range(4000)]), "denied": pa.array([[]] * 4000, pa.list_(pa.string()))})
    block = knn._Block(asked, 8, 5, None)
    tracemalloc.start()
    block.add(held)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # bytes; a table of questions by chunks has 80e6
