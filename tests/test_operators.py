"""Edge cases of the engine's own operators, and the plans they must have."""

import random

import time

import pytest
from pyspark.sql import functions as F

from docmill.functions import chunking as C, scalars as S
from docmill.operators import access as A, hierarchy as H, relational as R, retrieval as V
from docmill.sources import files
from docmill.streaming import audit, tasks


def test_chunk_short_and_unpunctuated():
    assert len(C.chunk_text("a b c", 240, 48)) == 1
    assert C.chunk_text("  \n ", 240, 48) == []
    n = C.windows(1000, [1000], 240, 48)
    assert len(n) == 5 and n[0] == (0, 240) and n[-1][1] == 1000


def test_chunk_prefers_the_last_break():
    assert C.windows(500, [170, 230, 500], 240, 48)[0] == (0, 230)
    text = " ".join(["w"] * 200) + "\n\n" + " ".join(["w"] * 200)
    w = [(c["start_token"], c["end_token"]) for c in C.chunk_text(text, 240, 48)]
    assert w[0] == (0, 200) and w[1][0] == 152


@pytest.mark.parametrize("seed", range(20))
def test_chunk_invariants(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word", "😀x", "end.", "why?", "a"]) + r.choice([" ", " ", "\n", "\n\n", "  ", " "]) for _ in range(r.randrange(0, 900)))
    spans, chunks = C.word_spans(text), C.chunk_text(text, 60, 12)
    assert all(text[c["start_char"] : c["end_char"]] == c["text"] and 0 < c["end_token"] - c["start_token"] <= 60 for c in chunks)
    covered = {i for c in chunks for i in range(c["start_token"], c["end_token"])}
    assert covered == set(range(len(spans)))
    assert all(a["end_token"] - b["start_token"] <= 12 for a, b in zip(chunks, chunks[1:]))


def test_profiles_and_splitter():
    assert C.profile("application/pdf") == ("hybrid_structural_pdf_200_40", 200, 40)
    assert C.profile(None)[1:] == (240, 48)
    parts = C.split_recursive("para one. " * 300 + "\n\n" + "x" * 2500, 1000, 200)
    assert max(map(len, parts)) <= 1000 and "".join(parts).count("x") >= 2500
    assert C.headings("# Top\ntext\n2.1 Sub\nLOUD") == [(0, 1, "Top"), (2, 2, "Sub"), (3, 1, "LOUD")]


def test_literal_search_and_null_order(spark):
    df = spark.createDataFrame([(1, "50%_off"), (2, "50 off"), (3, None)], "id long, name string")
    assert [r.id for r in df.where(R.contains(["name"], "%_")).collect()] == [1]
    assert [r.id for r in df.orderBy(R.asc("name"), "id").collect()][-1] == 3
    assert [r.id for r in df.orderBy(R.desc("name"), "id").collect()][0] == 3


def test_pages(spark):
    df = spark.range(95)
    pages = [[r.id for r in R.page(df, [F.col("id")], n, 10).collect()] for n in range(1, 11)]
    assert sum(pages, []) == list(range(95))
    assert [r.id for r in R.page(df, [F.col("id")], 99, 10).collect()] == list(range(90, 95))
    assert R.page(df, [F.col("id")], 99, 10, clamp=False).count() == 0


def test_get_by_id_is_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, name string")
    assert R.get_by_id(df, "id", 1).count() == 1 and R.get_by_id(df, "id", 9).count() == 0
    with pytest.raises(Exception, match="more than one row"):
        R.get_by_id(df, "id", 2).collect()


def test_division_of_nothing(spark):
    links = spark.createDataFrame([(1, "a"), (2, "b")], "o long, i string")
    assert R.has_all(links, "o", "i", []).count() == 2
    assert R.has_all(links, "o", "i", ["a", "a"]).count() == 1


def test_trees_with_a_loop_and_a_long_chain(spark):
    loop = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "folder_id long, parent_id long")
    assert sorted(map(tuple, H.descendants(loop, 1).collect())) == [(1, 0), (2, 1), (3, 2)]
    assert {(r.folder_id, r.ancestor): r.hops for r in H.ancestors(loop).collect()} == {(a, b): (a - b) % 3 for a in (1, 2, 3) for b in (1, 2, 3)}
    assert H.visible(loop, loop).count() == 0
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1000)], "folder_id long, parent_id long")
    assert {r.folder_id: r.depth for r in H.descendants(chain, 0).collect()} == {i: i for i in range(1000)}
    assert H.descendants(chain, 990).count() == 10 and H.descendants(chain, 5, depth=3).count() == 4 and H.descendants(chain, 5000).count() == 0
    assert H.visible(chain, chain.where("folder_id <> 400")).count() == 400
    assert H.would_loop(chain, 3, 700).first()[0] and not H.would_loop(chain, 700, 3).first()[0]
    short = chain.where("folder_id < 150")
    assert H.ancestors(short).count() == 150 * 151 // 2 and H.ancestors(short, depth=2).count() == 150 + 149 + 148
    assert {(r.folder_id, r.ancestor, r.hops) for r in H.ancestors(chain.where("folder_id between 5 and 6")).collect()} == {(5, 5, 0), (5, 4, 1), (6, 6, 0), (6, 5, 1), (6, 4, 2)}


def test_a_wide_and_deep_tree(spark):
    tree = spark.range(200_000).select(F.col("id").alias("folder_id"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2)).alias("parent_id"))
    assert H.descendants(tree, 1).count() == 131_071


def test_deny_wins_unless_the_account_comes_first(spark):
    subjects = spark.createDataFrame([(1, "account", 1), (1, "role", 9)], "account_id long, subject_type string, subject_id long")
    docs = spark.createDataFrame([(5, 7)], "doc_id long, folder_id long")
    acl = spark.createDataFrame([(5, "role", 9, "deny", "read"), (5, "account", 1, "override", "write")], "doc_id long, subject_type string, subject_id long, precedence string, permission string")
    folders = spark.createDataFrame([], "folder_id long, subject_type string, subject_id long, permission string")
    decided = A.decisions(subjects, docs, acl, folders)
    assert A.allowed(decided).first().allowed is False
    assert A.allowed(decided, account_first=True).first().allowed is True


def test_filter_is_below_the_ranking(spark):
    chunks = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(30)], "chunk_id long, doc_id long, embedding array<double>")
    docs = spark.createDataFrame([(1,)], "doc_id long")
    top = V.permitted_top_k(chunks, chunks.where("chunk_id = 4"), docs, 5)
    assert {r.doc_id for r in top.collect()} == {1}
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("TakeOrderedAndProject") < plan.index("LeftSemi")


def test_context_placeholder(spark):
    none = spark.createDataFrame([], "chunk_id long, doc_id long, score double, text string")
    assert V.context(none).first().context == V.NO_CONTEXT


def test_scalars(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    assert value(S.resource(F.lit("/api/v1/users/45/roles/"))) == "users" and value(S.resource_id(F.lit("/api/users/45/"))) == "45"
    assert value(S.human_size(F.lit(0))) == "0 B" and value(S.human_size(F.lit(3 * 1024**4))) == "3072.00 GB"
    assert value(S.client_ip(F.lit(None).cast("string"), F.lit(""), F.lit("x" * 60))) == "x" * 45
    assert value(S.valid("password", F.lit("Passw0rd"))) is False and value(S.valid("password", F.lit("Passw0rd!"))) is True
    assert value(S.page_strip(F.lit(1), 3)) == [1, 2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# é")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path), {"application/pdf": lambda b: "pdf:" + b[:4].decode()}).collect()}
    assert got["a.md"].text == "# é" and got["b.pdf"].text == "pdf:%PDF"
    assert got["c.exe"].error == "unsupported type" and got["d.txt"].text is None and got["d.txt"].error
    assert files.read_texts(spark, str(tmp_path / "a.md")).count() == 1


def test_retry_exhaustion(spark):
    df = spark.createDataFrame([(1, 1), (2, 4)], "id long, retry_count int")
    got = {r.id: r for r in tasks.fail(df, "2024-01-01 00:00:00", 5).collect()}
    assert got[1].status == "retrying" and str(got[1].next_retry_at) == "2024-01-01 00:20:00"
    assert got[2].status == "failed" and got[2].next_retry_at is None


def test_streams(spark, tmp_path):
    rows = [(i, 1 if i < 8 else i, f"2024-01-01 10:{i:02d}:00", "LOGIN") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, account_id long, created_at string, action string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = audit.read_stream(spark, f"{tmp_path}/in", df.schema)
    audit.append(audit.entries(stream, "action"), f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 20
    seen = []
    audit.ingest(stream, lambda batch, n: seen.append((n, batch.count())), f"{tmp_path}/c2").awaitTermination(60)
    assert seen == [(0, 20)]
    windows = audit.frequent(stream, "created_at", "account_id", "1 hour", "1 hour", 5)
    q = windows.writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.account_id, r.attempts) for r in spark.sql("SELECT * FROM windows").collect()] == [(1, 8)]


def test_uploads_arrive_as_a_stream(spark, tmp_path):
    from docmill.streaming import uploads

    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "one two three"), (2, " "), (3, "bad words")], schema).write.parquet(f"{tmp_path}/in/a")
    embedder = lambda texts: [None if "bad" in t else [float(len(t)), 0.0] for t in texts]
    for extra in ([], [(4, "four")]):
        if extra:
            spark.createDataFrame(extra, schema).write.parquet(f"{tmp_path}/in/b")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        uploads.process(stream, "doc_id", "text", embedder, 2, f"{tmp_path}/points", f"{tmp_path}/status", f"{tmp_path}/ck").awaitTermination()
    assert {(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/points").collect()} == {(1, "one two three"), (4, "four")}
    assert {(r.doc_id, r.status) for r in spark.read.parquet(f"{tmp_path}/status").collect()} == {(1, "completed"), (2, "failed"), (3, "failed"), (4, "completed")}


def test_a_table_is_rebuilt_at_ticks(spark, tmp_path):
    from docmill.streaming import uploads

    made = []

    def rebuild():
        made.append(1)
        return spark.range(len(made) + 2)

    q = uploads.refresh(spark, rebuild, f"{tmp_path}/t", f"{tmp_path}/ck", "1 second")
    end = time.time() + 120
    try:
        while not (tmp_path / "t" / "version=1" / "_SUCCESS").exists() and time.time() < end and q.exception() is None:
            time.sleep(0.2)
    finally:
        q.stop()
    assert uploads.newest(spark, f"{tmp_path}/t").count() >= 4
    assert spark.read.parquet(f"{tmp_path}/t/version=0").count() == 3


def test_docx_and_unsupported_files(spark, tmp_path):
    import zipfile

    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.MD").write_text("# Ü")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("One\ttwo\nThree", None), "b.MD": ("# Ü", None), "c.exe": (None, "unsupported type"), "d.pdf": (None, "no parser")}


def test_a_failed_batch_spoils_no_other_row(spark):
    from docmill.operators import ingest as I

    def call(values):
        if "x" in values:
            raise I.ServiceError(400, "refused")
        return [v.upper() for v in values]

    got = I.called(spark.createDataFrame([("a",), ("x",), ("b",)], "v string").coalesce(1), "v", call, wait=0.0).collect()
    assert sorted((r.v, r.result, r.error) for r in got) == [("a", "A", None), ("b", "B", None), ("x", None, "400 refused")]


def test_an_upsert_of_another_dimension_fails(spark):
    from docmill.sources import store

    schema = "point_id long, embedding array<float>, payload map<string,string>"
    points = spark.createDataFrame([(1, [1.0, 2.0], {"a": "1", "b": "1"}), (2, [0.0, 1.0], None)], schema)
    new = spark.createDataFrame([(1, None, {"a": "2"}), (3, [5.0, 5.0], {"c": "3"})], schema)
    got = {r.point_id: (r.embedding, r.payload) for r in store.upsert_points(points, new, 2).collect()}
    assert got == {1: ([1.0, 2.0], {"a": "2", "b": "1"}), 2: ([0.0, 1.0], {}), 3: ([5.0, 5.0], {"c": "3"})}
    with pytest.raises(Exception, match="dimension"):
        store.upsert_points(points, spark.createDataFrame([(1, [1.0], None)], schema), 2).collect()
