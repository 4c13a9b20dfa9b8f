"""Embedding near duplicates against brute force."""

import numpy as np
import pytest

from docmill.llm import embedding_dedup
from docmill.llm.embedding_dedup import Plan, links


def _brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                n[i] += 1
                n[j] += 1
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {(i, n[i], find(i), find(i) == i) for i, _ in rows}


def _rows(seed, groups=(40, 7, 2, 2)):
    r = np.random.default_rng(seed)
    vectors = list(r.standard_normal((150, 16)))
    for g in groups:
        c = r.standard_normal(16)
        vectors += [c + r.standard_normal(16) * 0.08 for _ in range(g)]
    vectors += [vectors[3]] * 5 + [vectors[4] * 2]
    rows = [(i * 2, np.float32(v).tolist()) for i, v in enumerate(vectors)]
    return rows + [(901, None), (903, [0.0] * 16), (905, [1.0] * 15 + [float("nan")]), (907, [1.0] * 15 + [None]), (909, [1.0] * 4), (911, [1.0] * 4), (913, [float("inf")] + [1.0] * 15)]


@pytest.mark.parametrize("block", [8, 1024])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = _rows(1)
    got = links(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), plan=Plan(30, 4))
    assert {tuple(r) for r in got.collect()} == _brute(rows)


def test_plan():
    assert Plan.of(10**9, 0.95).hashes > Plan.of(10**4, 0.95).hashes
    assert abs(embedding_dedup.collision(1.0, 2.2) - 0.68) < 0.08


def test_empty(spark):
    assert links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
