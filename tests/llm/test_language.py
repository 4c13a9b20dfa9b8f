"""Language identification: kernel values by brute force, held-out accuracy, edges."""

import random

import numpy as np

from docmill.llm.language import LENGTHS, LanguageModel, fit, predict, presence


def test_kernel_is_the_blended_spectrum():
    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in LENGTHS for i in range(len(t) - n + 1)}

    a, b = "the cat sat on", "the hat on a cat"
    m = LanguageModel(["x"], np.packbits(presence([b]).astype(bool), axis=1))
    want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    assert abs(m.kernel([a], m.dense())[0, 0] - want) < 0.01


def _text(r, lang, n):
    parts = {"aa": ["the", "ing", "and", "er"], "bb": ["der", "ung", "ich", "en"], "cc": ["ción", "los", "que", "ado"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 3))) for _ in range(n))


def test_accuracy_and_edges(spark):
    r = random.Random(5)
    langs = ["aa", "bb", "cc"]
    rows = [(i, _text(r, langs[i % 3], r.randrange(1, 60)), langs[i % 3]) for i in range(600)]
    model = fit(spark.createDataFrame(rows[:400], "doc_id long, text string, lang string"))
    more = [(1001, None, None), (1002, "", None), (1003, "12 ... !", None), (1004, _text(r, "bb", 60_000), "bb")]
    got = {x.doc_id: x for x in predict(spark.createDataFrame(rows[400:] + more, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i].lang_pred == y for i, _, y in rows[400:]) >= 195
    assert [got[i].lang_pred for i in (1001, 1002, 1003, 1004)] == ["und", "und", "und", "bb"]
    assert all(0 <= x.score <= 1 for x in got.values())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert fit(docs) is None
    assert predict(docs, None).first().lang_pred == "und"
    assert predict(docs.limit(0), None).count() == 0
