"""Removal of repeated strings against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from docmill.llm import suffix_dedup
from docmill.llm.common import cut
from docmill.llm.suffix_dedup import multikey_quicksort, remove_repeats


def _brute(rows, length):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        seen.update(t[k : k + length] for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def _rows(seed):
    r = random.Random(seed)

    def noise(n):
        return "".join(r.choice("abcdef é\n") for _ in range(n))

    passages = [noise(r.randrange(30, 500)) for _ in range(8)]
    out = [noise(r.randrange(0, 900)) for _ in range(20)]
    for _ in range(50):
        out.append(noise(r.randrange(0, 250)) + r.choice(passages)[r.randrange(0, 20) :] + noise(r.randrange(0, 80)) + r.choice(passages) + noise(r.randrange(0, 100)))
    out += [out[3], out[3], "z" * 900, "xy" * 350, noise(60) + "z" * 300, passages[0][:199], passages[1][:200], "", None]
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "hot", "piece"), [(1, 20_000, 1 << 24), (2, 3, 1 << 24), (3, 20_000, 300)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "SORTED", 4096 if seed == 1 else 2)
    rows = _rows(seed)
    got = remove_repeats(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lo string"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert got == _brute(rows, 200)


def test_repeated_rows_and_ids(spark):
    a, b = "".join(random.Random(1).choices("abcdefgh ", k=400)), "".join(random.Random(2).choices("abcdefgh ", k=400))
    rows = [(1, a), (1, b), (2, b[:250]), (3, "short"), (3, "short"), (None, a)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 400), (1, 250), (1, 400), (2, 250), (3, 0), (3, 0)]


def test_overlap_with_a_row_without_an_id(spark):
    p, x, y, z = ("".join(random.Random(k).choices("abcdefgh ", k=400)) for k in range(4))
    rows = [(None, x[:90] + p[:300] + x[90:]), (7, y[:130] + p[:300] + y[130:]), (8, z[:50] + p[50:350] + z[50:])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == _brute([(i or 0, t) for i, t in rows], 200)
    got = remove_repeats(spark.createDataFrame(rows[:2], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 300), (7, 300)]


def test_a_text_beyond_packed_positions():
    size = (1 << 26) + (1 << 21)
    text = np.random.default_rng(9).integers(97, 123, size, dtype=np.uint8)
    text[size - 5_000 : size - 4_000] = text[1_000:2_000]
    whole, ahead, windows, most = text.tobytes(), [], 0, 0
    for pieces, _, base in suffix_dedup._pieces([whole], 200, suffix_dedup.PIECE):
        most = max(most, sum(map(len, pieces)))
        piece, lo, n, offset, gram, reach, _ = suffix_dedup.named_suffixes(pieces, 200)
        windows += int(n.sum())
        ahead += zip((lo + base[piece]).tolist(), n.tolist(), offset.tolist(), gram.tolist(), reach.tolist())
    assert most <= suffix_dedup.PIECE + 199 and windows == size - 199
    inside = [{(n, offset, gram, reach) for lo, n, offset, gram, reach in ahead if a < lo and lo + n + 199 < a + 1_000} for a in (1_000, size - 5_000)]
    assert inside[0] == inside[1] and len(inside[0]) > 3
    late = [h for h in ahead if h[0] > 1 << 26][::500]
    assert all(gram == suffix_dedup.named_suffixes([whole[lo : lo + n + 199]], 200)[4][0] for lo, n, _, gram, _ in late)


def test_sort():
    words = np.random.default_rng(1).integers(0, 3, (3000, 4)).astype(np.uint64)
    order = multikey_quicksort(words)
    assert (words[order] == words[np.lexsort(words.T[::-1])]).all()


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_buckets_by_splitters():
    r = np.random.default_rng(4)
    sample = np.array(list(zip(r.integers(0, 5, 300).tolist(), r.integers(-3, 3, 300).tolist(), [0] * 300)), [("lead", "<i8"), ("reach", "<i8"), ("gram", "<i8")])
    sample["lead"][:120], sample["reach"][:120] = 2, 9
    cuts, often = suffix_dedup._splitters(sample, "reach", 16)
    assert often.tolist() == [9] or set(often.tolist()) >= {9}
    keys = list(zip(*(x.tolist() for x in cuts)))
    assert keys == sorted(set(keys))
    lead, second = r.integers(-1, 6, 500), r.integers(-5, 11, 500)
    want = [sum(k <= key for k in keys) for key in zip(lead.tolist(), second.tolist())]
    assert suffix_dedup._buckets(cuts, lead, second).tolist() == want
    none, few = suffix_dedup._splitters(sample[:0], "reach", 16)
    assert not len(none[0]) and not len(few) and suffix_dedup._buckets(none, lead, second).tolist() == [0] * 500
    assert not len(suffix_dedup._splitters(sample[-3:], "gram", 16)[1]) or len(set(sample[-3:]["lead"].tolist())) < 3


def test_one_reach_of_a_third_of_all(spark):
    r = random.Random(5)
    line = "".join(r.choices("abcdefgh ", k=230))
    rows = [(i, line if i % 3 == 0 else "".join(r.choices("abcdefgh ", k=260)) + line + "".join(r.choices("abcdefgh ", k=40))) for i in range(240)] + [(999, " " * 700)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got.collect()) == _brute(rows, 200)


def _nested_python(plan):
    """Python functions of a plan that run in one stage with another one: a worker more for each task."""
    above, found = [], 0
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:+-]*", line)[0])
        above = [x for x in above if x[0] < depth]
        stage = [name for _, name in above]
        stage = stage[max((i for i, name in enumerate(stage) if "Exchange" in name), default=-1) + 1 :]
        name = line[depth:].split(" ")[0]
        found += name == "MapInArrow" and "MapInArrow" in stage
        above.append((depth, name))
    return found


def test_one_python_function_in_a_stage(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(suffix_dedup, "cut", noted)
    r = random.Random(14)
    p, q, x, y = ("".join(r.choices("abcdefgh ", k=300)) for _ in range(4))
    got = remove_repeats(spark.createDataFrame([(1, x + p), (2, p + y), (3, q), (4, None)], "doc_id long, text string"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum(x.count("MapInArrow") for x in plans) >= 6
    assert [_nested_python(x) for x in plans] == [0] * len(plans)
    assert {(g.doc_id, g.n_removed, bytes(g.kept).decode()) for g in got.collect()} == {(1, 300, x), (2, 300, y), (3, 0, q), (4, 0, "")}
