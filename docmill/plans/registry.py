"""Collects the queries of the engine's own operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.plans.proxies import Loader

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: registers fn(spark, sf_dir) under name, with its DuckDB SQL."""

    def put(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle:
            _ORACLE[name] = oracle
        return fn

    return put


def query(name: str, oracle: str | None = None):
    """Decorator: registers fn(t), t being the loader of the test tables and entity views."""
    def put(fn):
        register(name, oracle)(lambda spark, sf_dir: fn(Loader(spark, sf_dir)))
        return fn

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries by name."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The oracle SQL of those queries that have one."""
    _load()
    return dict(_ORACLE)


def _load() -> None:
    """Imports the modules that register queries."""
    from docmill.plans import access_queries, analytics_queries, document_queries, further_queries, ingest_queries, relational_queries, scalar_queries, search_queries, workflow_queries  # noqa: F401
