"""The task queue as a stateful stream: each task's state is kept by key, retries are timers, and a batch replay gives the same.

Events are ``(task_id, seq, at, kind, percent)`` with kinds create, start,
progress, complete and fail. A failed task waits 5 min * 2^attempts and is then
pending again by itself, until its attempts are used up. An event that doesn't
fit the state (a completion of what isn't running, anything after the end)
changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts of a task before it has failed for good, and the first wait.
ATTEMPTS, WAIT = 3, timedelta(minutes=5)
#: Rows of a transition.
TRANSITION = "task_id long, at timestamp, from_status string, to_status string, attempts int, percent int, next_retry_at timestamp"
_STATE = "status string, attempts int, percent int, retry timestamp"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Task:
    """A task's state; a new one has no status."""

    status: str = ""
    attempts: int = 0
    percent: int = 0
    retry: datetime | None = None

    def wake(self, task_id: int, now: datetime) -> Iterator[tuple]:
        """The end of a wait that is due."""
        if self.status == "retrying" and self.retry is not None and self.retry <= now:
            at, self.retry = self.retry, None
            yield self._to(task_id, at, "pending")

    def take(self, task_id: int, at: datetime, kind: str, percent: int | None, most: int) -> Iterator[tuple]:
        """The event's transition, if it has one, after a wait that was due by then."""
        yield from self.wake(task_id, at)
        if kind == "create" and self.status == "":
            yield self._to(task_id, at, "pending")
        elif kind == "start" and self.status == "pending":
            self.percent = 0
            yield self._to(task_id, at, "running")
        elif kind == "progress" and self.status == "running" and percent is not None:
            self.percent = min(100, max(0, int(percent)))
        elif kind == "complete" and self.status == "running":
            self.percent = 100
            yield self._to(task_id, at, "completed")
        elif kind == "fail" and self.status == "running":
            self.attempts += 1
            if self.attempts < most:
                self.retry = at + WAIT * 2**self.attempts
            yield self._to(task_id, at, "failed" if self.attempts >= most else "retrying")

    def _to(self, task_id: int, at: datetime, status: str) -> tuple:
        before, self.status = self.status, status
        return task_id, at, before or None, status, self.attempts, self.percent, self.retry


def _events(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.sort_values(["at", "seq"], kind="stable")
    percent = [None if pd.isna(x) else int(x) for x in frame["percent"]]
    return list(zip((t.to_pydatetime() for t in frame["at"]), frame["kind"], percent))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in TRANSITION.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"task_id": "int64", "at": "datetime64[ns]", "attempts": "int32", "percent": "int32", "next_retry_at": "datetime64[ns]"})


class QueueProcessor(StatefulProcessor):
    """Keeps each task's state, with an event-time timer while it waits."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("task", _STATE)

    def _load(self) -> Task:
        if not self.state.exists():
            return Task()
        status, attempts, percent, retry = self.state.get()
        return Task(status, attempts, percent, None if retry is None else pd.Timestamp(retry).to_pydatetime().replace(tzinfo=None))

    def _save(self, task: Task) -> None:
        self.state.update((task.status, task.attempts, task.percent, task.retry))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        task, out = self._load(), []
        before = task.retry
        for at, kind, percent in _events(pd.concat(list(rows), ignore_index=True)):
            out += task.take(int(key[0]), at, kind, percent, self.most)
        if before != task.retry:
            if before is not None:
                self.handle.deleteTimer(_millis(before))
            if task.retry is not None:
                self.handle.registerTimer(_millis(task.retry))
        self._save(task)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        task = self._load()
        out = list(task.wake(int(key[0]), datetime(1970, 1, 1) + timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())))
        self._save(task)
        yield _frame(out)

    def close(self) -> None:
        pass


def _millis(at: datetime) -> int:
    return (at - datetime(1970, 1, 1)) // timedelta(milliseconds=1)


def _columns(events: DataFrame) -> DataFrame:
    return events.select(F.col("task_id").cast("long").alias("task_id"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), "kind", F.col("percent").cast("int").alias("percent"))


def transitions(events: DataFrame, most: int = ATTEMPTS, late: str = "10 minutes") -> DataFrame:
    """The stream of all transitions of a stream of events; state by task, restarted from the stream's checkpoint.

    Events of one task come in order, or at most ``late`` out of order within a
    batch; later ones are dropped by the watermark. Times are those of the
    session's time zone, which must be UTC. Spark keeps the state in RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = _columns(events).withWatermark("at", late)
    return rows.groupBy("task_id").transformWithStateInPandas(QueueProcessor(most), TRANSITION, "Append", "EventTime")


def replay(events: DataFrame, until: str | None = None, most: int = ATTEMPTS) -> DataFrame:
    """The transitions of all events as a batch; waits that are due by ``until`` end too. A task's events are one group."""
    end = None if until is None else datetime.fromisoformat(until)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        task, out = Task(), []
        for at, kind, percent in _events(frame):
            out += task.take(int(key[0]), at, kind, percent, most)
        if end is not None:
            out += task.wake(int(key[0]), end)
        return _frame(out)

    return _columns(events).where("task_id is not null").groupBy("task_id").applyInPandas(run, TRANSITION)


def states(changes: DataFrame) -> DataFrame:
    """Each task's newest state, from its transitions: ``(task_id, status, attempts, next_retry_at)``."""
    order = F.struct("at", F.expr("array_position(array('pending', 'running', 'retrying', 'failed', 'completed'), to_status)"))
    newest = F.max_by(F.struct("to_status", "attempts", "next_retry_at"), order)
    return changes.groupBy("task_id").agg(newest.alias("x")).select("task_id", F.col("x.to_status").alias("status"), "x.attempts", "x.next_retry_at")
