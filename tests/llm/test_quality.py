"""The line field: features and sums against plain versions, held-out accuracy on made texts, edges."""

import itertools
import random

import numpy as np
import pyarrow as pa

from docmill.llm import quality as Q


def test_features():
    x, sizes, bounds = Q.line_features(pa.array(["", "Ab cd ab ab!\n\n  \nX|9 é", " \n", "A b\nA b\nB a"]))
    assert bounds.tolist() == [0, 0, 2, 2, 5] and sizes.tolist() == [13, 6, 4, 4, 3]
    f = [dict(zip(Q.FEATURES, r)) for r in x]
    assert f[0]["capitals"] == 1 / 8 and f[0]["repeated"] == 0 and f[0]["distinct"] == 1 and f[0]["shouts"] == 1 / 4 and f[0]["begins"] == 1
    assert f[1]["bars"] == 1 / 2 and f[1]["digits"] == 1 / 5 and f[1]["beyond"] == 2 / 5 and f[1]["words"] == np.log1p(2)
    assert [f[i]["same_line"] for i in (2, 3, 4)] == [0, 1, 0]
    y = dict(zip(Q.FEATURES, Q.line_features(pa.array(["to to to be to."]))[0][0]))
    assert y["repeated"] == 2 / 5 and y["distinct"] == 3 / 5 and y["ends"] == 1
    assert len(Q.line_features(pa.array([], pa.string()))[0]) == 0 and len(Q.line_features(pa.array(["", ""]))[0]) == 0


def test_long_texts_in_pieces(monkeypatch):
    texts = ["Some words here.\n" * 50, "", "x y\nz", "word " * 40 + "\nend"]
    whole = Q.line_features(pa.array(texts))
    monkeypatch.setattr(Q, "PIECE", 300)
    for a, b in zip(whole, Q._features(pa.array(texts))):
        assert a.shape == b.shape
        if a.ndim == 1:
            assert a.tolist() == b.tolist()


def test_sums_equal_all_paths():
    r = np.random.default_rng(1)
    pairs, bounds = r.normal(size=(2, 2)), np.array([0, 5, 5, 6, 9])
    e = r.normal(size=9)
    p, total, odds = Q.forward_backward(e, pairs, bounds)
    inner, k = [], 0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        n = hi - lo
        if n == 0:
            continue
        paths = list(itertools.product((0, 1), repeat=n))
        w = np.array([np.exp(sum(e[lo + i] * y for i, y in enumerate(c)) + sum(pairs[a, b] for a, b in zip(c, c[1:]))) for c in paths])
        assert np.allclose(total[lo:hi], np.log(w.sum()))
        for i in range(n):
            assert np.isclose(p[lo + i], w[[c[i] == 1 for c in paths]].sum() / w.sum())
        for i in range(1, n):
            want = [w[[c[i - 1] == a and c[i] == b for c in paths]].sum() / w.sum() for a in (0, 1) for b in (0, 1)]
            assert np.allclose(odds[:, k], want)
            k += 1
    assert k == odds.shape[1]


def _texts(n, r):
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    good = lambda: " ".join(r.choice(words) for _ in range(r.randrange(4, 30))).capitalize() + "."
    bad = [lambda: good().upper() + "!!", lambda: " | ".join(r.choice(words) for _ in range(12)), lambda: " ".join([r.choice(words)] * 12), lambda: good().replace(" ", "%% ")]
    rows = []
    for i in range(n):
        y = int(r.random() < 0.8)
        lines = [good() for _ in range(r.randrange(1, 8))]
        if not y:
            junk = r.choice(bad)
            lines = lines[:1] + [junk() for _ in range(r.randrange(3, 12))]
        rows.append((i, "\n".join(lines), y))
    return rows


def test_learns(spark):
    rows = _texts(900, random.Random(4))
    train = spark.createDataFrame([(*r, "en") for r in rows[:600]], "doc_id long, text string, quality int, lang string")
    model = Q.fit(train.drop("quality"), train.select("doc_id", "quality"), per_label=300)
    held = spark.createDataFrame([(*r[:2], 7.0) for r in rows[600:]], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in Q.score(held, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows[600:]) >= 290
    p = Q.forward_backward(model.evidence(model.intervals(Q.line_features(pa.array([rows[0][1]]))[0]), np.array([0, rows[0][1].count("\n") + 1])), model.pairs, np.array([0, rows[0][1].count("\n") + 1]))[0]
    assert (p > 0.5).all() == bool(rows[0][2])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (3, "x " * 50_000), (None, "\n\n"), (4, "\n".join(["Good line."] * 30_000))], "doc_id long, text string")
    none = spark.createDataFrame([(1, 1), (3, 1), (9, 0), (2, 5), (2, None)], "doc_id long, quality int")
    assert Q.fit(docs, none) is None and {r.score for r in Q.score(docs, None).collect()} == {0.5}
    rows = _texts(200, random.Random(5))
    train = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = Q.fit(train, train.select("doc_id", "quality"))
    got = [(r.doc_id, r.score) for r in Q.score(docs, model).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got) and len({s for i, s in got if i in (None, 1, 2)} - {None}) <= 2
    assert Q.score(docs.limit(0), model).count() == 0
