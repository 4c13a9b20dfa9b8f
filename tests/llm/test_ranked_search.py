"""Ranked search against a brute-force version: ties, copies, nulls, many shards and blocks; MaxScore reads less than all postings."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from docmill.llm import ranked_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, k):
    words = [(i, Counter(_terms(t))) for i, t in docs]
    total, length = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(_terms(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in words:
            m = 10 + 90 * sum(w.values()) * total // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in terms if w[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def _run(spark, tmp_path, docs, items, k, most=4_000_000, **options):
    path = f"{tmp_path}/index-{random.random()}"
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, score int").repartition(3)
    S.build_index(table, path, most=most)
    asked = S.asked_terms(spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"))
    got = S.search(S.read_index(spark, path), asked, k, **options)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def _docs(n, r):
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randrange(0, 60)))) for i in range(n)]
    return docs


def test_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    docs = _docs(700, r) + [(i, "W1 w2, w250!") for i in range(2000, 2040)] + [(None, "w250 w251"), (None, None), (9, ""), (9, "w250 w7"), (9, "w250 w7"), (5000, "Ünï w3 " * 3000)]
    items = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(1, 25)))) for i in range(60)]
    items += [(60, "W250"), (61, "nothing-here zzz"), (62, None), (63, ""), (None, "w250 ünï"), (64, "w1 w2"), (64, "w250")]
    want = _brute(docs, items, 10)
    assert _run(spark, tmp_path, docs, items, 10) == want
    assert _run(spark, tmp_path, docs, items, 10, most=500, block_terms=40) == want  # many shards, many blocks


def test_empty_tables(spark, tmp_path):
    assert _run(spark, tmp_path, [(1, None), (2, "!")], [(1, "a")], 10) == []
    assert _run(spark, tmp_path, [(1, "a b")], [(1, None)], 10) == []
    for docs, items in (([], [(1, "a")]), ([(1, "a")], [])):
        path = f"{tmp_path}/{len(docs)}"
        S.build_index(spark.createDataFrame(docs, "doc_id long, text string"), path)
        asked = S.asked_terms(spark.createDataFrame(items, "item_id long, text string"))
        assert S.search(S.read_index(spark, path), asked).count() == 0


def test_max_score_is_exact_and_reads_less():
    r = np.random.default_rng(3)
    docs = 60_000
    for trial in range(12):
        lists = []
        for share in (0.6, 0.3, 0.2, 0.01, 0.002, 0.001):
            places = np.flatnonzero(r.random(docs) < share)
            lists.append((places, (r.random(len(places)) * 1000 * -math.log(share) + (0 if trial % 2 else 1)).astype(np.int64)))
        total = np.zeros(docs, np.int64)
        for p, x in lists:
            total[p] += x
        want = np.lexsort((np.arange(docs), -total))[:10]
        places, scores, read = S.best(lists, docs, 10)
        assert places.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
        assert read < 0.5 * sum(len(p) for p, _ in lists)
    ties = [(np.arange(docs), np.full(docs, 7))]
    assert S.best(ties, docs, 10)[0].tolist() == list(range(10)) and S.best(ties, docs, 10)[2] == S.STEP
