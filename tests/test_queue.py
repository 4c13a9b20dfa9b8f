"""The queue's stream and its batch replay give the same transitions, over restarts; timers end waits."""

import random
from datetime import datetime, timedelta

from docmill.streaming import queue as Q

START = datetime(2024, 1, 1)
SCHEMA = "task_id long, seq long, at timestamp, kind string, percent int"


def _events(r, tasks):
    out = []
    for t in range(tasks):
        at = START + timedelta(seconds=r.randrange(3600))
        out.append((t, 0, at, "create", None))
        for i in range(1, r.randrange(2, 14)):
            at += timedelta(minutes=r.choice([0, 1, 3, 11, 25]), seconds=r.randrange(60))
            out.append((t, i, at, r.choice(["start", "start", "start", "fail", "fail", "progress", "complete", "create"]), r.choice([None, -5, 40, 170])))
    return sorted(out, key=lambda e: (e[2], e[0], e[1]))


def _rows(df):
    return sorted((r.task_id, r.at, r.from_status or "", r.to_status, r.attempts, r.percent, str(r.next_retry_at)) for r in df.collect())


def test_rules():
    task = Q.Task()
    steps = [("create", 0), ("complete", 0), ("start", 1), ("fail", 2), ("start", 3), ("start", 12), ("fail", 13), ("start", 34), ("fail", 35), ("start", 200)]
    got = [x for kind, m in steps for x in task.take(7, START + timedelta(minutes=m), kind, None, 3)]
    assert [(x[2], x[3], x[4], (x[1] - START).seconds // 60) for x in got] == [
        (None, "pending", 0, 0), ("pending", "running", 0, 1), ("running", "retrying", 1, 2), ("retrying", "pending", 1, 12), ("pending", "running", 1, 12),
        ("running", "retrying", 2, 13), ("retrying", "pending", 2, 33), ("pending", "running", 2, 34), ("running", "failed", 3, 35),
    ]


def test_stream_equals_replay_over_restarts(spark, tmp_path):
    events = _events(random.Random(4), 60)
    end = events[-1][2] + timedelta(days=1)
    events.append((10**6, 0, end, "create", None))  # moves the watermark past all waits
    cuts = [0, len(events) // 4, len(events) // 2, 3 * len(events) // 4, len(events)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(events[a:b], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = Q.transitions(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(300) and q.exception() is None
    every = spark.createDataFrame(events, SCHEMA)
    want = Q.replay(every, (end - timedelta(minutes=10)).isoformat())
    assert _rows(spark.read.parquet(f"{tmp_path}/out")) == _rows(want)
    last = {r.task_id: r.status for r in Q.states(want).collect()}
    assert "retrying" not in last.values() and len(last) == 61
    waiting = Q.states(Q.replay(every)).where("status = 'retrying'")
    assert waiting.count() > 0 and waiting.where("next_retry_at is null").count() == 0


def test_replay_of_nothing(spark):
    assert Q.replay(spark.createDataFrame([(None, 1, START, "create", None)], SCHEMA)).count() == 0
