"""Scalar functions at the edges of their units."""

import datetime

import duckdb

from docmill.functions import scalars as S
from docmill.plans import registry


def test_ages_count_whole_seconds(spark):
    """Times a fraction of a second off the edge of each unit, before 1970 and after now too, against the query's own SQL."""
    now, edges = datetime.datetime(2024, 1, 31), (0, 3600, 7200, 86_400, 172_800, 604_800, 1_209_600, 2_592_000, 1_706_659_200)
    times = [now - datetime.timedelta(seconds=e, microseconds=f) for e in edges for f in (-1_000_001, -999_999, -500_000, -1, 0, 1, 500_000, 999_999, 1_000_001)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    duck.executemany("INSERT INTO events (event_id, ts) VALUES (?, ?)", list(enumerate([*times, None])))
    rows = spark.createDataFrame(list(enumerate([*times, None])), "event_id long, ts timestamp_ntz")
    got = rows.select("event_id", S.relative_time("ts", "2024-01-31 00:00:00").alias("age")).collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(registry.oracle_sql()["c22_relative_time"]).fetchall())
