"""Nearest neighbours: recall against brute force, exact scores, edges."""

import numpy as np
import pytest

from docmill.llm import ann


def _brute(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {i: sorted(((-(v @ w), j) for j, w in good.items() if j != i and len(v) == len(w)))[:k] for i, v in good.items() if i % 20 == 0}


@pytest.mark.parametrize("shard", [100 * 24, 1 << 21])
def test_recall_and_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "LEAST", shard)
    r = np.random.default_rng(2)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(r.standard_normal((1500, 24)) + r.integers(0, 5, 1500)[:, None])]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, 2.0]), (2061, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0, 20).collect()
    want, hit, total = _brute(rows, 20), 0, 0
    assert {r.query_id for r in got} == set(want)
    for q, best in want.items():
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [x.rank for x in mine] == list(range(1, len(best) + 1))
        assert [(-x.score, x.vec_id) for x in mine] == sorted((-x.score, x.vec_id) for x in mine)
        hit += len({x.vec_id for x in mine} & {j for _, j in best})
        total += len(best)
    assert hit / total >= 0.9


@pytest.mark.parametrize("n", [500, 2000, 6000])
def test_recall_of_vectors_without_structure(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "LEAST", 1500)
    x = np.random.default_rng(n).standard_normal((n, 64))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, 20).collect()
    want = _brute(rows, 20)
    hit = sum(r.vec_id in {j for _, j in want[r.query_id]} for r in got)
    assert hit / sum(map(len, want.values())) >= 0.95


def test_clustered_vectors_need_few_candidates():
    r = np.random.default_rng(9)
    x = np.repeat(r.standard_normal((100, 64)), 40, axis=0) + 0.1 * r.standard_normal((4000, 64))
    forest = ann.Forest(x, np.arange(4000), x.mean(0), 48, 11)
    assert forest.enough(x[::20], np.arange(0, 4000, 20), 20, 0.97) < 400


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(20, [1.0, 0.0], 1, 2.0), (20, [0.9, 0.1], 1, 2.0), (1, [0.5, 0.5], 1, 2.0), (1, [0.5, 0.5], 1, 2.0), (None, [1.0, 0.0], 1, 2.0), (3, [0.1, None], 1, 2.0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double"), lambda i: i % 20 == 0, 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got) == [(20, 1, 1, 0.5), (20, 2, 1, 0.5), (20, 3, 1, 0.5), (20, 4, 1, 0.5)]


def test_ties_and_few(spark):
    rows = [(i, [1.0, 0.0]) for i in range(41)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0, 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (20, 1, 0), (20, 2, 1), (20, 3, 2), (40, 1, 0), (40, 2, 1), (40, 3, 2)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).count() == 0
