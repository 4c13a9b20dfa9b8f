"""The n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from docmill.llm import jaccard_join
from docmill.llm.jaccard_join import join, trie_links


def _set(text, n=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _components(rows, percent=85):
    sets = [(i, _set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def _rows(seed, size=260):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(r.choice(words) for _ in range(14))
    out = []
    while len(out) < size:
        base = [r.choice(words) for _ in range(r.randrange(1, 90))]
        for _ in range(r.choice([1, 1, 1, 2, 5, 30])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                t[r.randrange(len(t))] = r.choice(words)
            if r.random() < 0.4:
                t = [line, *t]
            out.append(r.choice(["\n", " ", "\t "]).join(t) if r.random() < 0.9 else " ".join(t).upper())
    ids = r.sample(range(5 * size), len(out))
    return [*zip(ids, out), (90001, None), (90002, ""), (90003, " \n"), (90004, "a b"), (90005, "A  B"), (90006, "a b c")]


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True), (3, True)])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    if small:
        for name, value in {"BLOCK": 4, "BUCKET": 4, "SHORT": 3, "OFTEN": 5, "ENTRIES": 300}.items():
            monkeypatch.setattr(jaccard_join, name, value)
    rows = _rows(seed)
    got = join(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string"))
    assert sorted(map(tuple, got.collect())) == _components(rows)


def test_ids_of_several_texts_and_none(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    a, b, c = (" ".join(r.choice(words) for _ in range(200)) for _ in range(3))
    near = lambda t: t + " end"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (3, near(b)), (7, c), (7, c), (None, near(c)), (None, near(c)), (None, c), (9, ""), (9, near(c)), (None, None)]
    got = join(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((-1 if i is None else i, n, -1 if x is None else x) for i, n, x in got.collect())
    assert found == sorted([(1, 197, 1), (1, 197, 1), (2, 198, 1), (3, 198, 1), (3, 198, 1), (7, 197, 7), (7, 197, 7), (-1, 198, 7), (-1, 198, 7), (-1, 197, 7), (9, 0, 9), (9, 198, 7), (-1, 0, -1)])


def test_a_row_without_an_id_links_others(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(120)]
    text = lambda a, b: " ".join([*(f"a{i}" for i in range(a)), *words, *(f"b{i}" for i in range(b))])
    rows = [(1, text(12, 0)), (None, text(0, 0)), (2, text(0, 12)), (None, "alone " * 3), (None, "alone " * 3)]
    a, b, c = (set(zip(*[t.split()[i:] for i in range(4)])) for _, t in rows[:3])
    assert 100 * len(a & b) >= 85 * len(a | b) and 100 * len(b & c) >= 85 * len(b | c) and 100 * len(a & c) < 85 * len(a | c)
    got = join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((-1 if i is None else i), (-1 if x is None else x)) for i, _, x in got.collect()) == [(-1, -1), (-1, -1), (-1, 1), (1, 1), (2, 1)]


def test_one_id_of_many_texts(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(30)) for _ in range(700)]
    texts += [f"{t} end" for t in texts[:300]]
    rows = [(5, t) for t in texts] + [(i + 10, f"{t} more") for i, t in enumerate(texts[600:720])] + [(None, t) for t in texts[:40]]
    got = join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    apart = [(i, t) for i, (_, t) in enumerate(rows)]
    alone = {i: c for i, _, c in _components(apart)}
    with_5 = {alone[i] for i, (x, _) in enumerate(rows) if x == 5}
    want = sorted(((-1 if x is None else x), 5 if alone[i] in with_5 else -1 if x is None else min(rows[j][0] for j in range(len(rows)) if alone[j] == alone[i] and rows[j][0] is not None)) for i, (x, _) in enumerate(rows))
    assert sorted(((-1 if i is None else i), (-1 if c is None else c)) for i, _, c in got) == want


def test_many_short_documents_of_one_line(spark):
    r = random.Random(5)
    line = " ".join(f"l{i}" for i in range(16))
    rows = [(i, f"{line} {' '.join(f'w{r.randrange(10**6)}' for _ in range(r.randrange(0, 6)))}") for i in range(600)]
    got = join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == _components(rows)


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ENTRIES", 1000)
    r = random.Random(6)
    text = " ".join(f"w{r.randrange(10**5)}" for _ in range(40_000))
    rows = [(1, text), (2, text + " more"), (3, text[: len(text) // 2])]
    got = join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x[0]: x[2] for x in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_short_sets_of_which_no_common_ngram_is_counted_first(spark):
    r = random.Random(10)
    base = [[f"w{r.randrange(10**6)}" for _ in range(r.randrange(9, 30))] for _ in range(300)]
    rows = [(2 * i + k, " ".join([*w, *["end"] * k])) for i, w in enumerate(base) for k in range(2)]
    got = join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == _components(rows)


def test_an_id_without_text_is_no_text_without_an_id(spark):
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(120)) for _ in range(20)]
    rows = [x for i, t in enumerate(texts) for x in [(t, None), (None, t), (f"d{i:02}", f"{t} end")]]
    got = join(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((n, c) for i, n, c in got if i is None) == [(117, f"d{i:02}") for i in range(20)]


@pytest.mark.parametrize("seed", range(30))
def test_trie(seed):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(8):
        base = r.integers(0, 300, r.integers(1, 60))
        for _ in range(int(r.integers(1, 8))):
            x = base.copy()
            x[: int(r.integers(0, 3))] = r.integers(0, 300)
            sets.append(np.unique(x).astype(np.uint64))
    up = list(range(len(sets)))

    def comps(edges):
        up = list(range(len(sets)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in edges:
            p, q = sorted((find(a), find(b)))
            up[q] = p
        return [find(i) for i in up]

    brute = [(i, j) for i in up for j in up[:i] if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert comps(trie_links(up, sets, 85)) == comps(brute)


def test_empty(spark):
    assert join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
