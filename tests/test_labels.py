"""Tree labels against plain climbing: random forests, loops, chains, moves; ranges reach the scan."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import labels as L


def _below(up, root):
    out, todo = {}, [(root, 0)]
    while todo:
        x, d = todo.pop()
        for c, p in up.items():
            if p == x:
                out[c] = d + 1
                todo.append((c, d + 1))
    return out


def _frame(spark, up):
    return spark.createDataFrame([(i, p, f"n{i}") for i, p in up.items()], "id long, parent_id long, name string")


def test_forests_and_moves(spark):
    r = random.Random(3)
    up = {0: None, -7: None} | {i: r.choice([0, -7, *range(1, i)]) for i in range(1, 90)} | {200: 999}
    rows = L.labelled(_frame(spark, up)).cache()
    assert [x.id for x in rows.where("label is not null").orderBy("label").limit(1).collect()] == [-7]
    for root in (0, 5, 88):
        assert {x.id: x.depth for x in L.descendants(rows, root).collect()} == _below(up, root)
    chain, x = {}, 80
    while up[x] is not None:
        x = up[x]
        chain[x] = len(chain) + 1
    assert {x.id: x.hops for x in L.ancestors(rows, 80).collect()} == chain
    sums = {x.id: x.total for x in L.subtree_sums(rows, F.lit(1)).collect()}
    assert sums == {i: 1 + len(_below(up, i)) for i in up}
    down = next(i for i in up if i > 5 and i in _below(up, 5))
    with pytest.raises(ValueError, match="below itself"):
        L.moved(rows, 5, down)
    with pytest.raises(ValueError, match="below itself"):
        L.moved(rows, 5, 5)
    with pytest.raises(ValueError, match="no label"):
        L.descendants(rows, 12345)
    outside = next(i for i in range(60, 90) if i not in _below(up, 5) and i != 5)
    for to in (outside, None):
        after = up | {5: to}
        fresh = {(x.id, x.parent_id, x.label) for x in L.labelled(_frame(spark, after)).collect()}
        assert {(x.id, x.parent_id, x.label) for x in L.moved(rows, 5, to).collect()} == fresh
    rows.unpersist()


def test_loops_have_no_label(spark):
    up = {1: 2, 2: 3, 3: 1, 4: 3, 5: 5, 10: None, 11: 10, 12: 11}
    got = {x.id: x.label for x in L.labelled(_frame(spark, up)).collect()}
    assert {i for i, x in got.items() if x is None} == {1, 2, 3, 4, 5} and len(got[12]) == 3 * L.STEP
    assert L.labelled(_frame(spark, up).limit(0)).count() == 0


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds, real = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: rounds.append(1) or real(df))
    nodes = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert L.descendants(L.labelled(nodes), 250).count() == 49 and len(rounds) <= 11


def test_a_subtree_is_a_range_of_the_scan(spark, tmp_path):
    nodes = spark.range(5000).select("id", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 6)).alias("parent_id"))
    L.store(L.labelled(nodes), f"{tmp_path}/tree")
    rows = spark.read.parquet(f"{tmp_path}/tree")
    found = L.descendants(rows, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(label" in plan and "LessThan(" in plan.split("PushedFilters")[1] and "Join" not in plan
    assert found.count() == sum(1 for _ in _all_below(7, 5000, 6))


def _all_below(root, n, width):
    todo = [root]
    while todo:
        x = todo.pop()
        for c in range(x * width + 1, min(x * width + width + 1, n)):
            yield c
            todo.append(c)
