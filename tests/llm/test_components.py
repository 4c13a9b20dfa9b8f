"""Connected components against a union-find."""

import random

import pytest

from docmill.llm.components import components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 450)] + [(7, 7)]
    up = list(range(500))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.id: x.component for x in got.collect()} == want
    assert got.count() == len(want)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
