"""Decisions of all pairs by blocks of accounts, against plain SQL on odd tables; counts of pairs that aren't made."""

import random

import duckdb
import pytest

from docmill.operators import access as A
from docmill.plans import access_queries as Q

TABLES = {
    "p_accounts": "account_id long, is_deleted boolean",
    "p_account_roles": "account_id long, role_id long",
    "p_documents": "doc_id long, folder_id long",
    "p_document_permissions": "doc_id long, subject_type string, subject_id long, precedence string, permission string",
    "p_folder_permissions": "folder_id long, subject_type string, subject_id long, permission string",
}
SQL = Q._DECIDED + "SELECT account_id, doc_id, denied, ov, lv, own_denied, own_ov FROM x"


def _tables(spark, seed):
    """Repeated grants and memberships, repeated and unknown documents, accounts without roles, own grants of documents and folders."""
    r = random.Random(seed)
    kind = lambda: (t := r.choice(["account", "role", "role", "other"]), r.randrange(40) if t == "account" else r.randrange(5))
    rows = {
        "p_accounts": [(i, i % 9 == 0) for i in range(40)],
        "p_account_roles": [(r.randrange(44), r.choice([0, 0, 1, 2, 3])) for _ in range(60)],
        "p_documents": [(i, r.choice([None, 1, 2, 3, 4])) for i in range(30)] + [(3, 1), (3, 2), (None, 1)],
        "p_document_permissions": [(r.choice([None, *range(34)]), *kind(), r.choice(["deny", "override", "override", "inherit", None]), r.choice(["read", "write", "delete", None])) for _ in range(60)],
        "p_folder_permissions": [(r.choice([None, 1, 2, 3, 5]), *kind(), r.choice(["read", "write", "delete", None])) for _ in range(9)],
    }
    duck = duckdb.connect()
    for name, schema in TABLES.items():
        duck.execute(f"CREATE TABLE {name} ({schema.replace('long', 'BIGINT').replace('string', 'VARCHAR')})")
        duck.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(schema.split(',')))})", rows[name])
    return {n: spark.createDataFrame(rows[n], s) for n, s in TABLES.items()}, duck


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 3), (3, 1)])
def test_decisions_equal_sql(spark, monkeypatch, seed, block):
    monkeypatch.setattr(A, "BLOCK", block)
    t, duck = _tables(spark, seed)
    subjects = A.subjects(t["p_accounts"].where("not is_deleted"), t["p_account_roles"])
    rest = t["p_documents"], t["p_document_permissions"], t["p_folder_permissions"]
    got = A.decisions(subjects, *rest).selectExpr("account_id", "doc_id", "coalesce(denied, false)", "override_level", "folder_level", "own_denied is true", "own_level").collect()
    want = [(*x[:5], x[5] is True, x[6]) for x in duck.execute(SQL).fetchall()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and want
    counts = duck.execute(f"{Q._DECIDED} SELECT account_id, count(*) FROM x GROUP BY 1").fetchall()
    assert sorted(map(tuple, A.decided_counts(subjects, *rest).collect())) == sorted(counts)


def test_pairs_are_not_shuffled(spark):
    """2,000 accounts of one role and 100 documents meet in blocks: what moves is far less than the 200,000 pairs."""
    accounts = spark.range(2000).withColumnRenamed("id", "account_id")
    subjects = A.subjects(accounts, accounts.selectExpr("account_id", "0L as role_id"))
    docs = spark.range(100).selectExpr("id as doc_id", "1L as folder_id")
    none = spark.createDataFrame([], TABLES["p_document_permissions"])
    rows = A.decisions(subjects, docs, none, spark.createDataFrame([(1, "role", 0, "read")], TABLES["p_folder_permissions"]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(CASE WHEN isnull(_but") < plan.index("SortMergeJoin [roles")
    parts = rows.selectExpr("account_id", "doc_id", "spark_partition_id() as part").toPandas()
    assert len(parts) == 200_000 and parts.part.nunique() > 1
    runs = parts[parts.part == parts.part[0]].reset_index(drop=True)
    assert (runs.account_id != runs.account_id.shift(-1)).sum() > 1 and (runs.doc_id != runs.doc_id.shift(1)).sum() < len(runs) / 200


def test_counts_make_no_pairs(spark):
    t, _ = _tables(spark, 4)
    plan = A.decided_counts(A.subjects(t["p_accounts"], t["p_account_roles"]), t["p_documents"], t["p_document_permissions"], t["p_folder_permissions"])._jdf.queryExecution().executedPlan().toString()
    assert "_accounts" not in plan and "_block" not in plan
