"""Toxicity: folding, matching, exceptions, and held-out accuracy on made rows."""

import random

from docmill.llm.toxicity import ToxicityModel, fit, fold, score


def test_fold():
    assert fold("You 1D10T! і​diot Ídíot") == " you idiot idiot idiot "
    assert fold("") == "  "


def test_exceptions_cancel():
    m = ToxicityModel({" scum ": 4.0, " lowei": 5.0}, frozenset({"pond scum"}))
    assert m.features("pond scum here")[1] == 0
    assert m.features("what scum here")[1] > 0
    assert m.features("so loweichen")[1] > 0 and m.features("solowei")[1] == 0
    assert list(m.hits(fold("scum scum"))) and len(list(m.hits(fold("scum scum")))) == 2


def _rows(n, r):
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        toxic = int(r.random() < 0.2)
        text = [r.choice(words) for _ in range(r.randrange(5, 80))]
        if toxic:
            for _ in range(max(1, len(text) // 12)):
                text.insert(r.randrange(len(text)), r.choice(["idi0t", "zorkoid", "zorkels", "SCUM"]))
        elif r.random() < 0.1:
            text += ["lake", "scum"]
        out.append((i, " ".join(text), toxic))
    return out


def test_learns(spark):
    rows = _rows(1500, random.Random(3))
    train = spark.createDataFrame(rows[:1000], "doc_id long, text string, toxic int")
    model = fit(train.drop("toxic"), train.select("doc_id", "toxic"))
    assert any(k.startswith(" zork") for k in model.weights) and "lake scum" in model.exceptions
    got = {r.doc_id: r.score for r in score(spark.createDataFrame([r[:2] for r in rows[1000:]], "doc_id long, text string"), model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows[1000:]) >= 490


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " * 50_000, 0), (3, "x " * 50_000, 0)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(docs, none)
    got = sorted(tuple(r) for r in score(docs, model).collect())
    assert [i for i, _ in got] == [1, 2, 3, 3] and all(0 <= s <= 1 for _, s in got) and got[0][1] == got[1][1]
    assert score(docs.limit(0), model).count() == 0
