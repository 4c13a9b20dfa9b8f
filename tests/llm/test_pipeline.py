"""The corpus pipeline against a brute-force version on made documents."""

import base64
import hashlib
import math
import random
import struct
from collections import Counter

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm.mixing import n_words, weights


def _made(seed=6):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randrange(2, 8))) for _ in range(500)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts = []
    for _ in range(60):
        t = [r.choice(words) for _ in range(r.randrange(1, 120))]
        if r.random() < 0.3:
            t.insert(r.randrange(len(t) + 1), passage)
        texts.append(" ".join(t))
        if r.random() < 0.4:
            t[0] = "other"
            texts.append(" ".join(t))
    texts += [None, "", "123 !?", texts[0], passage, passage]
    return [(i, t, "en" if i % 2 else None, r.choice(["a", "a", "a", "a", "b", "c"]), len(t or "")) for i, t in enumerate(texts)]


def _brute(rows):
    rows = [r for r in rows if r[1] is not None and any(map(str.isalpha, r[1]))]
    sets = []
    for r in rows:
        w = r[1].lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in up[:]:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    seen = Counter(t[k : k + 200] for r in rows for t in [r[1].encode()] for k in range(len(t) - 199))
    kept = []
    for r in rows:
        t = r[1].encode()
        gone = set()
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        left = bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore")
        if left or not gone:
            kept.append((r[0], left, r[3], len(left.split())))
    tokens = Counter()
    for _, _, s, n in kept:
        tokens[s] += n
    total = sum(tokens.values())

    def powers(t):
        p = {s: (n / total) ** t for s, n in tokens.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    def entropy(w):
        return -sum(x * math.log(x) for x in w.values())

    def bisect(good):
        lo, hi = 0.0, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(powers(mid)) else (lo, mid)
        return (lo + hi) / 2

    goal = math.log(len(tokens)) * corpus_pipeline.ENTROPY
    worst = lambda w: max(w[s] * total / n for s, n in tokens.items())
    t = 1.0 if entropy(powers(1)) >= goal else bisect(lambda w: entropy(w) >= goal)
    if worst(powers(0)) > corpus_pipeline.REPEATS:
        t = max(t, bisect(lambda w: worst(w) > corpus_pipeline.REPEATS))
    plan = {s: math.floor(round(w, 9) * total) for s, w in powers(round(t, 9)).items()}
    out, before = [], Counter()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text, s, n in sorted(kept, key=lambda k: (hashlib.md5(f"1:{plan[k[2]] // tokens[k[2]]}:{k[0]}".encode()).hexdigest(), k[0])):
        copies = plan[s] // tokens[s] + (before[s] < plan[s] % tokens[s] and n > 0)
        before[s] += n
        ids = enc.encode_ordinary(text)
        out += [(i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * copies
    return sorted(out)


def test_equals_brute_force(spark, tmp_path):
    rows = _made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_clashing_columns_nulls_and_repeats(spark):
    text = "some words that stay " * 3
    rows = [(1, text, "en", "a", len(text), 7, "k", 1), (1, text, "en", "a", len(text), 7, "k", 1), (None, "other words here", None, None, None, None, None, None), (3, "x " * 60_000, "en", "b", 120_000, 1, "k", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, _lang string, copies int")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "_lang", "copies"]
        if name == "language_id":
            assert docs.count() == 4
        if name == "suffix_array_dedup":  # one of equal rows stays, the long text is all one repeated passage
            want = [(1, text, "en", "a", len(text), 7, "k", 1), (None, "other words here", "en", None, 16, None, None, None)]
            assert sorted(map(tuple, docs.collect()), key=repr) == sorted(want, key=repr)
        if name == "source_mixing":
            assert {(r.doc_id, r.text, r.kept) for r in docs.collect()} == {(1, text, 7), (None, "other words here", None)}
    assert {(r.doc_id, r.decoded_sha256) for r in docs.collect()} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in ((1, text), (None, "other words here"))}


def test_passages_of_rows_without_an_id_or_with_a_repeated_one(spark):
    r = random.Random(8)
    p, q, x, y, z = ("".join(r.choices("abcdefgh ", k=300)) for _ in range(5))
    rows = [(None, x + p), (1, p + y), (1, z), (2, q), (2, q), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.remove_passages(spark, docs, "").collect())
    assert got == Counter({(None, x, 300): 1, (1, y, 300): 1, (1, z, 300): 1, (3, "", 0): 1, (None, "", 0): 1})  # p goes in both, q wholly


def test_coding_of_null_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "ab"), (1, None), (1, ""), (2, "x"), (2, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.encode_bytes(spark, docs, "").collect()))
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(0, 1, h("ab")), (1, 0, h("")), (1, 0, h("")), (2, 1, h("x")), (2, 1, h("x"))]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _unlike(n):
    return " ".join(f"{chr(97 + n)}{k}w" for k in range(20))


def test_rows_without_an_id_or_with_a_repeated_one(spark):
    a, b, c, d, e, f = map(_unlike, range(6))
    rows = [(None, a), (None, a + " more"), (None, b), (None, c), (5, c), (6, c), (7, d), (7, e), (8, f), (8, f), (None, ""), (None, None), (None, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    firsts = [k for k in got if k[1] in (a, a + " more")]
    assert len(firsts) == 1 and got.pop(firsts[0]) == 1  # of near copies without an id, one
    assert got == Counter([(None, b), (5, c), (7, d), (7, e), (8, f), (None, ""), (None, None), (None, None), (9, None)])


def test_every_row_is_mixed_on_its_own(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "x y", "s")] * 3 + [(1, "z", "s"), (None, "u v w", "s"), (None, "u v w", "s"), (None, "other", "s"), (2, "x y", "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema)
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert got == Counter(rows)  # one source: its budget is all its tokens
    rows = [(1, "x y z", "a")] * 40 + [(None, "x y z", "a")] * 40 + [(1, "x", "b")] * 7 + [(k, "x y", "b") for k in range(9)] + [(None, "x y", None)] * 5
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema)
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    counted = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "source", n_words().alias("n_tokens"))
    plan = {p.source: p for p in weights(counted, corpus_pipeline.ENTROPY, corpus_pipeline.REPEATS).collect()}
    for source, size in (("a", 3), (None, 2)):  # texts of one length: the copies follow from the budget
        whole, rest = divmod(plan[source].budget, plan[source].tokens)
        n = sum(1 for r in rows if r[2] == source)
        assert sum(k for r, k in got.items() if r[2] == source) == n * whole + -(-rest // size)
    assert set(got) == {r for r in rows if r[2] != "a"} | {r for r in got if r[2] == "a"}


def test_language_without_labels_and_with_und_as_one(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["some words", "éa", "12 !", None, ""]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], schema)
    assert sorted((r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [(0, None), (1, None)]
    docs = spark.createDataFrame([(i, t, "und", "s", 1) for i, t in enumerate(texts)], schema)
    assert sorted((r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [(0, "und"), (1, "und")]


def test_texts_are_coded_in_small_batches(spark, monkeypatch):
    def rows_of_batch(docs, *_):
        def run(batches):
            for b in batches:
                n = pa.array([bytes(4 * b.num_rows)] * b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), n, n], names=["doc_id", "ids", "decoded"])

        return docs.select("doc_id").mapInArrow(run, "doc_id long, ids binary, decoded binary")

    monkeypatch.setattr(corpus_pipeline, "encode_column", rows_of_batch)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(0, 5_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = [r.n_tokens for r in corpus_pipeline.encode_bytes(spark, docs, "").collect()]
    assert len(got) == 5_000 and max(got) <= 2_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
