"""Heading trees, summaries and re-ingestion of changed documents."""

import random

from pyspark.sql import functions as F

from docmill.functions import chunking, outline as O
from docmill.operators import ingest as I


def test_outline():
    text = "intro here\n# One\na b\n### Deep\nc\n## Mid\n\n# Two\n2.1 Part\nd e"
    got = [(n, p, level, sib, path) for n, p, level, sib, _, path, _ in O.outline(text)]
    assert got == [(0, None, 0, 0, []), (1, None, 1, 1, ["One"]), (2, 1, 3, 0, ["One", "Deep"]), (3, 1, 2, 1, ["One", "Mid"]), (4, None, 1, 2, ["Two"]), (5, 4, 2, 0, ["Two", "Part"])]
    assert [x[-1].strip() for x in O.outline(text)] == ["intro here", "a b", "c", "", "", "d e"]
    assert O.outline("") == [] and O.outline(" \n ") == [] and len(O.outline("plain")) == 1 and len(O.outline("# a\n# a")) == 2


def test_summary():
    assert O.summary("Cats sleep. Dogs run far. Cats and dogs run. Nothing!", 2) == "Dogs run far. Cats and dogs run."
    assert O.summary("One. Two. Three.", 2) == "One. Two." and O.summary(" \n", 2) == "" and O.summary("no end", 1) == "no end"


def test_section_chunks(spark):
    docs = spark.createDataFrame([(1, "# A\nx y z.\n## B\nq r. x s."), (2, None), (3, ""), (4, "only text"), (4, "only text")], "doc_id long, text string")
    got = sorted((r.doc_id, r.section, r.parent or 0, "/".join(r.path), r.kind, r.sequence, r.text) for r in O.section_chunks(docs, "doc_id", "text").collect())
    assert got == sorted([
        (1, 1, 0, "A", "summary", 0, "x y z. x s."), (1, 1, 0, "A", "detail", 0, "x y z."), (1, 2, 1, "A/B", "summary", 0, "q r. x s."), (1, 2, 1, "A/B", "detail", 0, "q r. x s."),
        *[(4, 0, 0, "", k, 0, "only text") for k in ("summary", "detail")] * 2,
    ])
    assert O.section_rows(docs.limit(0), "doc_id", "text").count() == 0


def test_pieces_hold_the_text(spark):
    r = random.Random(1)
    words = lambda n, end=" ": end.join(f"w{r.randrange(10**6)}" for _ in range(n))
    texts = ["", "a b", words(400, ""), words(90, ". ") + "\n\n" + words(160, ". "), words(900), words(300, "\n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = chunking.pieces(docs, "doc_id", "text", 1000, 200).collect()
    by = {i: [r for r in rows if r.doc_id == i] for i in range(len(texts))}
    for i, t in enumerate(texts):
        assert all(0 < len(r.text) <= 1200 for r in by[i])
        squeezed = "".join(t.split())
        at = 0
        for r in by[i]:  # the pieces cover the text in order, with overlaps
            piece = "".join(r.text.split())
            found = squeezed.find(piece, max(0, at - 400))
            assert 0 <= found <= at
            at = max(at, found + len(piece))
        assert at == len(squeezed)


def test_reingest_calls_for_new_texts_only(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [None if "bad" in t else [float(len(t)), 1.0] for t in texts]

    schema = "doc_id long, text string"
    old = spark.createDataFrame([(1, "a1 b1 c1. d1 e1 f1."), (2, "same text here."), (3, "kept as it is."), (5, "old text stays.")], schema)
    stored, _ = I.ingest(old, "doc_id", "text", embed, 2, 3, 0)
    stored = stored.persist()
    stored.count()
    calls.value = 0
    new = spark.createDataFrame([(1, "d1 e1 f1. new words here."), (2, "same text here."), (4, "new words here."), (5, "a bad text."), (6, " ")], schema)
    points, status = I.reingest(stored, new, "doc_id", "text", embed, 2, 3, 0, wait=0.0)
    got = {(r.doc_id, r.sequence, r.text, tuple(r.embedding)) for r in points.collect()}
    known = {r.doc_id: (r.status, r.kept, r.embedded) for r in status.collect()}
    assert known == {1: ("completed", 1, 1), 2: ("completed", 1, 0), 4: ("completed", 0, 1), 5: ("failed", 0, 1), 6: ("failed", 0, 0)}
    assert calls.value == 2  # "new words here." once for two documents, and the bad one
    fresh, _ = I.ingest(new.where("doc_id in (1, 2, 4)"), "doc_id", "text", embed, 2, 3, 0)
    rest = stored.where("doc_id in (3, 5)")
    assert got == {(r.doc_id, r.sequence, r.text, tuple(r.embedding)) for r in fresh.unionByName(rest).collect()}
    stored.unpersist()
    assert points.where(F.col("embedding").isNull()).count() == 0
