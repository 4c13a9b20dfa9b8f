"""Source divergence against a brute-force version, with nulls, clashes, empty tables and texts in pieces."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from docmill.llm.divergence import divergence
from docmill.llm.terms import term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def _brute(rows, min_docs, top):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", TERM.findall(_lower(text or ""))
        groups.add((lang, source))
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = sorted(t for t, k in df[lang].items() if k >= min_docs)
        mine = [s for g, s in groups if g == lang]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = shares(n[lang, source]), shares(sum((n[lang, s] for s in mine), Counter()))
        pairs = []
        for s in mine:
            if s != source:
                other = shares(n[lang, s])
                pairs.append((-sum(abs(p[t] - other[t]) for t in kept), s.encode(), s))
        told = [(q[t] - p[t], t.encode(), t) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(told)[:top])):
            out += [(lang, source, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def _random(n, seed):
    r = random.Random(seed)
    words = ["The", "the", "é", "Éa", "ß", "a1b", "don't", "x", "naïve", "中文", "Z"] + [f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(60)]
    rows = []
    for _ in range(n):
        text = None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))
        rows.append((r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "é"]), text))
    return rows + [("fr", "only", "Ça va"), ("nl", "x", None), ("nl", "y", "")]


def test_equals_brute_force(spark):
    rows = _random(500, 1)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, n int")
    got = sorted(tuple(r) for r in divergence(docs, min_docs=30, top=5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == _brute(rows, 30, 5)
    assert ("nl", "x", "pair", "y", 0, 1) in got  # no kept term


def test_repeats_count_and_an_empty_table_gives_none(spark):
    rows = _random(60, 2)
    docs = spark.createDataFrame(rows * 2, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence(docs, min_docs=4).collect()) == _brute(rows * 2, 4, 50)
    assert divergence(docs.limit(0)).count() == 0


def test_terms_of_texts_in_pieces():
    r = random.Random(3)
    texts = ["", "x", " ".join(r.choice(["ab", "Ab", "c9", "é"]) for _ in range(400)), "y" * 3000, "q-" * 50, "tail"]
    for digits in (False, True):
        pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+") if digits else TERM
        want = sorted((i, t, k) for i, x in enumerate(texts) for t, k in Counter(pattern.findall(_lower(x))).items())
        for piece in (64, 1000, 1 << 20):
            rows, codes, counts, terms = term_counts(pa.array(texts), digits, piece)
            assert sorted(zip(rows.tolist(), terms.take(pa.array(codes)).to_pylist(), counts.tolist())) == want
    assert not len(term_counts(pa.array(["", ""], pa.string()), True)[0])
    assert not len(term_counts(pa.array([], pa.string()), True)[0])
