"""Evaluation measures against a brute-force version."""

import random
import re

import pytest

from docmill.operators import evaluation as E


def _words(t):
    return set(re.findall("[a-z0-9]+", (t or "").lower()))


def _sentences(t):
    return [w for w in map(_words, re.split(r"[.!?\n]+", t or "")) if w]


def _aligned(a, b, back):
    out, at = [], 0
    for x in a:
        lo = 0 if back is None else max(0, at - back)
        best = max(((len(x & y) / len(x), -j) for j, y in enumerate(b) if j >= lo), default=(0, 0))
        if best[0] > 0:
            at = -best[1]
        out.append(best[0])
    return out


def _mean(x):
    return sum(x) / len(x) if x else 0.0


@pytest.mark.parametrize("back", [None, 0, 1])
def test_equals_brute_force(spark, back):
    r = random.Random(back or 7)
    text = lambda n: None if r.random() < 0.1 else "".join(r.choice(["alpha", "Beta", "c3", "dé", "e", "f"]) + r.choice([" ", " ", " ", ". ", "!\n"]) for _ in range(r.randrange(n)))
    rows = [(i, text(6), text(20), text(40), text(15), 1.0) for i in range(120)] + [(998, "", "", "", "", 0.0), (999, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, question string, answer string, context string, wanted string, faithfulness double")
    got = {x.id: (x.faithfulness, x.answer_relevance, x.context_relevance, x.context_recall) for x in E.evaluate(df, reference="wanted", back=back).collect()}
    for i, q, a, c, w, _ in rows:
        asked, held = _words(q), _sentences(c)
        want = (_mean(_aligned(_sentences(a), held, back)), len(asked & _words(a)) / len(asked) if asked else 0, _mean([len(asked & y) / len(asked) for y in held]) if asked else 0, _mean(_aligned(_sentences(w), held, None)))
        assert got[i] == pytest.approx(want), i
