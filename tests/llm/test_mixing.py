"""Mixing: weights, budgets and block permutations against plain Python."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from docmill.llm.mixing import blocks, mix, n_words, weights


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def _rows():
    r = random.Random(4)
    return [(i, r.choice(["a"] * 8 + ["b", "c", None]), " ".join(["w"] * r.randrange(0, 40))) for i in range(900)] + [(5000, "a", None), (5001, "d", "")]


def test_entropy_target(spark):
    docs = _docs(spark, _rows()).withColumn("n_tokens", n_words())
    got = {r.source: r for r in weights(docs, target_entropy=0.8).collect()}
    assert set(got) == {"a", "b", "c", None}
    w = [r.weight for r in got.values()]
    assert abs(sum(w) - 1) < 1e-6
    assert abs(-sum(x * math.log(x) for x in w) - 0.8 * math.log(4)) < 1e-5


def test_repeat_limit(spark):
    docs = _docs(spark, _rows()).withColumn("n_tokens", n_words())
    got = weights(docs, target_entropy=0.99, most_repeats=1.5).collect()
    assert max(r.budget / r.tokens for r in got) <= 1.5 + 1e-6 and max(r.budget / r.tokens for r in got) > 1.49


def test_copies(spark):
    rows = _rows()
    docs = _docs(spark, rows)
    plan = weights(docs.withColumn("n_tokens", n_words()), target_entropy=0.8)
    got = {r.doc_id: r for r in mix(docs, n_words(), plan).collect()}
    assert len(got) == len(rows)
    for p in plan.collect():
        whole, rest, before = p.budget // p.tokens, p.budget % p.tokens, 0
        own = sorted((hashlib.md5(f"1:{whole}:{i}".encode()).hexdigest(), i, len((t or "").split())) for i, s, t in rows if s == p.source)
        for _, i, n in own:
            assert got[i].copies == whole + (before < rest and n > 0)
            before += n
    assert got[5001].copies == 0
    each = blocks(mix(docs, n_words(), plan))
    assert each.count() == sum(r.copies for r in got.values())
    assert each.groupBy("doc_id", "block").count().where(F.col("count") > 1).count() == 0
    # The last block is a prefix of its own permutation, but for documents without tokens.
    rows_of = {i: (s, len((t or "").split())) for i, s, t in rows}
    for p in plan.collect():
        last = p.budget // p.tokens
        taken = {r.doc_id: r.order_key for r in each.where(F.col("source").eqNullSafe(p.source) & (F.col("block") == last)).collect()}
        order = {i: hashlib.md5(f"1:{last}:{i}".encode()).hexdigest() for i, (s, n) in rows_of.items() if s == p.source and n}
        assert taken == {i: order[i] for i in taken} and max(taken.values(), default="") < min([k for i, k in order.items() if i not in taken], default="z")


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, "a", "z"), (2, None, "q r s")]
    docs = _docs(spark, rows).withColumns({"budget": F.lit(1), "tokens": F.lit("t"), "key": F.lit(0), "range": F.lit(0), "n": F.lit(0)})
    plan = weights(docs.withColumn("n_tokens", n_words()), target_entropy=0.9)
    got = mix(docs, n_words(), plan)
    assert got.columns == ["doc_id", "source", "n_tokens", "copies"] and got.count() == 4
    assert {(r.source, r.block) for r in blocks(got).collect()} >= {("a", 0)}


def test_empty(spark):
    docs = _docs(spark, [])
    plan = weights(docs.withColumn("n_tokens", n_words()), target_entropy=0.8)
    assert plan.count() == 0 and mix(docs, n_words(), plan).count() == 0
