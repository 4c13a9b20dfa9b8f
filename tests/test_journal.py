"""Uploads that die between any two steps go on without a double store; a slow older attempt is fenced off."""

import pytest

from docmill.operators import journal as J

DOCS = [(1, "one two three"), (2, " "), (3, "bad words"), (4, "four")]


class Died(Exception):
    pass


def _embedder(counter):
    def embed(texts):
        counter.add(len(texts))
        return [None if "bad" in t else [float(len(t)), 0.0] for t in texts]

    return embed


@pytest.mark.parametrize("at", J.STEPS)
def test_a_run_that_dies_is_taken_up(spark, tmp_path, at):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def die(step):
        if step == at:
            raise Died(step)

    with pytest.raises(Died):
        J.UploadJournal(spark, f"{tmp_path}/j", on_step=die).run(docs, "text", _embedder(calls), 2, wait=0.0)
    j = J.UploadJournal(spark, f"{tmp_path}/j")
    want = {1: "completed", 2: "failed", 3: "failed", 4: "completed"}
    now = {r.doc_id: r.status for r in j.status(docs).collect()}
    assert now == (want if at == "published" else dict.fromkeys(want, "processing"))
    before = calls.value
    number = j.run(docs, "text", _embedder(calls), 2, wait=0.0)
    assert number == (2 if at in ("taken", "points") else 0) and (calls.value == before) == (number == 0)
    assert {r.doc_id: r.status for r in j.status(docs).collect()} == want
    assert sorted((r.doc_id, r.text) for r in j.points().collect()) == [(1, "one two three"), (4, "four")]
    steps = {(r.step, r.to_status) for r in j.transitions().where("doc_id = 1").collect()}
    assert steps == {(1, "processing"), (2, "completed")}
    assert j.run(docs, "text", _embedder(calls), 2) == 0


def test_a_slow_older_attempt_is_fenced_off(spark, tmp_path):
    docs = spark.createDataFrame(DOCS[:1] + DOCS[3:], "doc_id long, text string")
    newer = J.UploadJournal(spark, f"{tmp_path}/j")

    def overtaken(step):
        if step == "taken":
            assert newer.run(docs, "text", lambda x: [[2.0, 2.0] for _ in x], 2) == 2

    slow = J.UploadJournal(spark, f"{tmp_path}/j", on_step=overtaken)
    assert slow.run(docs, "text", lambda x: [[1.0, 1.0] for _ in x], 2) == 1  # publishes after the newer one has
    assert {tuple(r.embedding) for r in newer.points().collect()} == {(2.0, 2.0)} and newer.points().count() == 2
    assert {(r.status, r.attempt) for r in newer.status(docs).collect()} == {("completed", 2)}


def test_failed_ones_again(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    j = J.UploadJournal(spark, f"{tmp_path}/j")
    assert {r.status for r in j.status(docs).collect()} == {"pending"} and j.points() is None
    calls = spark.sparkContext.accumulator(0)
    assert j.run(docs, "text", _embedder(calls), 2, wait=0.0) == 1
    assert j.run(docs, "text", lambda x: [[1.0, 2.0] for _ in x], 2, retry_failed=True) == 2
    assert {r.doc_id: r.status for r in j.status(docs).collect()} == {1: "completed", 2: "failed", 3: "completed", 4: "completed"}
    assert sorted(r.doc_id for r in j.points().collect()) == [1, 3, 4]
    new = docs.union(spark.createDataFrame([(9, "new")], docs.schema))
    assert {r.doc_id: r.status for r in j.status(new).where("doc_id = 9").collect()} == {9: "pending"}
