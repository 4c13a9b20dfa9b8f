"""The text index against a plain scan: additions, replacements, deletions, compaction; what a search reads."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docmill.operators import text_index as X


def _stem(w):
    if re.search("[^aeiou]ies$", w):
        w = w[:-3] + "y"
    elif re.search("(ss|x|ch|sh|zz)es$", w):
        w = w[:-2]
    elif re.search("[^su]s$", w) and len(w) > 3:
        w = w[:-1]
    if re.search("^.*[aeiouy].*[a-z]ing$", w) and len(w) > 5:
        return w[:-3]
    return w[:-2] if re.search("^.*[aeiouy].*[a-z]ed$", w) and len(w) > 4 else w


def _words(text):
    return [(i, _stem(w)) for i, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower())) if w not in X.STOP_WORDS]


def _scan(docs, query):
    asked = _words(query)
    words = {i: _words(t) for i, t in docs.items()}
    every = sorted(i for i, w in words.items() if {t for _, t in asked} <= {t for _, t in w})
    first = asked[0][0]
    phrase = {}
    for i, w in words.items():
        at = set(w)
        n = sum(all((p - first + q, t) in at for q, t in asked) for p in range(-50, 400))
        if n:
            phrase[i] = n
    mean = sum(map(len, words.values())) / len(words)
    scores = {}
    for t in dict.fromkeys(t for _, t in asked):
        df = sum(any(t == x for _, x in w) for w in words.values())
        for i, w in words.items():
            tf = sum(t == x for _, x in w)
            if tf:
                scores[i] = scores.get(i, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return every, phrase, scores


def _check(index, docs, query):
    every, phrase, scores = _scan(docs, query)
    assert sorted(r.id for r in index.all_of(query).collect()) == every
    assert {r.id: r.times for r in index.phrase(query).collect()} == phrase
    assert {r.id: round(r.score, 9) for r in index.bm25(query).collect()} == {i: round(s, 9) for i, s in scores.items()}
    best = sorted(((-round(s, 9), i) for i, s in scores.items()))[:7]
    assert sorted((-round(r.score, 9), r.id) for r in index.bm25(query, 7, first_cells=2).collect()) == best


def _texts(r, ids):
    words = ["The", "boxes", "boxed", "run", "running", "cities", "city", "pass", "grass", "of", "x1", "red", "Licence", "under"] + [f"w{i}" for i in range(40)]
    return {i: " ".join(r.choice(words) for _ in range(r.randrange(0, 30))) for i in ids}


def test_equals_a_scan_after_changes(spark, tmp_path):
    r = random.Random(2)
    index = X.TextIndex(spark, f"{tmp_path}/index")
    docs = _texts(r, [*range(0, 3000, 61), -5, 10**12])
    frame = lambda d: spark.createDataFrame([*d.items(), (None, "city")], "doc_id long, text string")
    assert index.add(frame(docs), "doc_id", "text") == 0
    new = _texts(r, [61, 62, 5000]) | {7000: None}
    gone = spark.createDataFrame([(122,), (999,), (None,)], "id long")
    assert index.add(frame(new), "doc_id", "text", gone) == 1
    docs = {i: t for i, t in (docs | new).items() if i != 122}
    for query in ("red of the box", "city city"):
        _check(index, docs, query)
    assert index.compact() == 2
    _check(index, docs, "passing boxes")
    assert index.all_of("the of").count() == 0 and index.phrase("the").count() == 0 and index.bm25("under", 3).count() == 0 and index.bm25("zzz unknown").count() == 0
    with pytest.raises(FileNotFoundError):
        X.TextIndex(spark, f"{tmp_path}/none").rows()


def test_an_addition_writes_its_cells_only(spark, tmp_path):
    index = X.TextIndex(spark, f"{tmp_path}/index")
    docs = spark.range(0, 20_000, 10).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id") % 97).alias("text"))
    index.add(docs, "doc_id", "text")
    index.add(spark.createDataFrame([(5001, "common new words")], "doc_id long, text string"), "doc_id", "text")
    cells = {r.cell for r in spark.read.parquet(f"{tmp_path}/index/segment=1/cells").collect()}
    assert cells == {5001 // X.CELL} and {r.cell for r in spark.read.parquet(f"{tmp_path}/index/segment=1/postings").select("cell").collect()} == cells
    assert index.all_of("common").count() == 2001 and sorted(r.id for r in index.all_of("new word").collect()) == [5001]


def test_a_search_reads_few_files_and_cells(spark, tmp_path):
    index = X.TextIndex(spark, f"{tmp_path}/index")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 15_000, "rare rare rare").otherwise(F.concat(F.lit("rare filler filler filler w"), F.col("id") % 300)).alias("text"))
    index.add(docs, "doc_id", "text")
    rows = index.rows(["rare"], ["most_tf", "least_n"])
    every = spark.read.parquet(f"{tmp_path}/index/segment=0/postings")
    read = rows.select(F.input_file_name()).distinct().count()  # of the files in the term's folder, which the plan below reads alone
    assert 0 < read <= every.where("bucket >= 0").select(F.input_file_name()).distinct().count() / 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "(term,rare)" in plan
    assert "postings" not in plan.split("ReadSchema")[1].split("\n")[0]
    terms, idf, mean = index._weights("rare", 1.2, 0.75)
    bounds = {r.cell: r.bound for r in index.bounds(terms, idf, mean).collect()}
    best = index.bm25("rare", 1, first_cells=1).collect()
    assert best[0].id == 15_000 and len(bounds) == 20
    assert sum(b >= best[0].score - 1e-9 for b in bounds.values()) == 1  # all other cells are ruled out


def test_words_are_gathered_before_they_move(spark, tmp_path):
    """Stems are those of the query side; what a word's postings need when they move is a few numbers."""
    import random

    from docmill.operators import text_index as T

    r = random.Random(5)
    ends = ["", "s", "es", "ies", "ing", "ed", "sses", "xes", "ches", "zzes", "uss", "eed", "ings", "eds", "oies"]
    words = sorted({"".join(r.choice("abcehinoqstuyz19") for _ in range(r.randrange(0, 5))) + e for e in ends for _ in range(60)} - {""})
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert {x.w: x.s for x in rows.withColumn("x", T.singular(F.col("w"))).select("w", T.bare(F.col("x")).alias("s")).collect()} == {w: T.stem(w) for w in words}
    docs = [(i, " ".join(r.choice(words[:60]) for _ in range(r.randrange(0, 30)))) for i in range(-1500, 3000, 7)] + [(5000, None), (5001, ""), (5002, ". , "), (14, "alpha beta"), (14, "beta gamma")]
    frame = spark.createDataFrame(docs, "id long, text string")
    want = {}
    for x in T.analysed(frame, "id", "text").collect():
        want.setdefault((x.id, x.term), []).append(x.position)
    index = T.TextIndex(spark, str(tmp_path / "index"))
    index.add(frame.where("id % 2 = 0"), "id", "text")
    index.add(frame.where("id % 2 <> 0"), "id", "text", spark.createDataFrame([(-1496,), (2704,)], "id long"))
    gone = {-1496, 2704}
    got = {(p.id, x.term): list(p.positions) for x in index.rows().where("term is not null").collect() for p in x.postings}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if k[0] not in gone}
    lengths = {p.id: p.n for x in index.documents().collect() for p in x.postings}
    assert lengths == {i: sum(len(v) for (j, _), v in want.items() if j == i) for i in {i for i, _ in docs} - gone}
    plan = T._rows(T._postings(frame, "id", "text"), "bigint")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
