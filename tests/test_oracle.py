"""Every query with oracle SQL against DuckDB at the smallest scale."""

import datetime
import decimal
import os

import duckdb
import pytest

from docmill.plans import registry
from docmill.plans.proxies import TABLES

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = _rows(got.fetchall(), [names.index(c) for c in sorted(names)])
    assert _rows(df.collect(), [df.columns.index(c) for c in sorted(df.columns)]) == want


def test_every_query_has_a_name_of_its_own():
    assert set(ORACLE) <= set(QUERIES)
