"""Generic relational operators: scans, filters, probes, pages, links and keyed writes.

Orders follow the rule ascending = nulls last, descending = nulls first, and
every limited order ends with a unique key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def base_scan(df: DataFrame, with_deleted: bool = False) -> DataFrame:
    """Rows that aren't soft-deleted, or all of them."""
    return df if with_deleted else df.where(~F.col("is_deleted"))


def equals(**filters) -> Column:
    """Conjunction of equality conditions; None means IS NULL."""
    conditions = [F.col(k).isNull() if v is None else F.col(k) == v for k, v in filters.items()]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; fails when collected if the key isn't unique (an empty result is the caller's not-found)."""
    rows = df.where(F.col(key) == value)
    unique = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("_n", unique).where(F.when(F.col("_n") > 1, F.raise_error("more than one row for the key")).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def first_by(df: DataFrame, order: list[Column], **filters) -> DataFrame:
    """First row of an equality filter, in this total order."""
    return df.where(equals(**filters)).orderBy(*order).limit(1)


def exists(df: DataFrame, condition: Column, name: str = "found") -> DataFrame:
    """One row: whether any row meets the condition."""
    return df.where(condition).limit(1).agg((F.count("*") > 0).alias(name))


def contains(columns: list[str], term: str) -> Column:
    """Case-insensitive literal substring in any of the columns; null columns don't match."""
    hits = [F.coalesce(F.contains(F.upper(F.col(c)), F.upper(F.lit(term))), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def asc(c: str) -> Column:
    """Ascending, nulls last."""
    return F.col(c).asc_nulls_last()


def desc(c: str) -> Column:
    """Descending, nulls first."""
    return F.col(c).desc_nulls_first()


def page(df: DataFrame, order: list[Column], number: int, size: int, clamp: bool = True) -> DataFrame:
    """A numbered page; past the end it is the last page, or with clamp=False empty.

    The clamped page needs the row count first: one cheap job.
    """
    if clamp:
        n = df.count()
        number = min(max(number, 1), max(1, -(-n // size)))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    """total_items and total_pages of a paged list."""
    return df.agg(F.count("*").alias("total_items")).withColumn("total_pages", F.ceil(F.col("total_items") / size).cast("long"))


def page_envelope(df: DataFrame, numbers: list[int], size: int) -> DataFrame:
    """``(number, total, pages, has_next, has_previous)`` of the asked pages of a list; one count."""
    info = page_info(df, size).select(F.explode(F.array(*[F.lit(n).cast("long") for n in numbers])).alias("number"), F.col("total_items").alias("total"), F.col("total_pages").alias("pages"))
    return info.withColumns({"has_next": F.col("number") < F.col("pages"), "has_previous": F.col("number") > 1})


def after_key(df: DataFrame, ts: str, key: str, cursor: tuple, size: int) -> DataFrame:
    """Keyset page: the rows after (ts, key) in descending order; no offset, so any page costs the same."""
    at = F.lit(cursor[0]).cast(df.schema[ts].dataType)
    later = (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < cursor[1]))
    return df.where(later).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(size)


def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows with a partner."""
    return df.join(other, on, "left_semi")


def has_all(links: DataFrame, owner: str, item: str, wanted: list) -> DataFrame:
    """Owners linked to every wanted item (relational division); all owners if none is wanted."""
    if not wanted:
        return links.select(owner).distinct()
    return links.where(F.col(item).isin(wanted)).groupBy(owner).agg(F.countDistinct(item).alias("_n")).where(F.col("_n") == len(set(wanted))).select(owner)


def missing_links(links: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Wanted links that aren't there yet: what get-or-create appends."""
    return wanted.select(*on).distinct().join(links, on, "left_anti")


def replace_set(links: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Changes that turn links into wanted: each with change 'add' or 'remove'."""
    add = wanted.select(*on).distinct().join(links, on, "left_anti").withColumn("change", F.lit("add"))
    remove = links.select(*on).distinct().join(wanted, on, "left_anti").withColumn("change", F.lit("remove"))
    return add.unionByName(remove)


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the changes' non-null values, and the changes' new rows (what a keyed overwrite writes)."""
    new = changes.select(*[F.col(c).alias(f"_{c}") for c in changes.columns])
    joined = df.join(new, F.col(key) == F.col(f"_{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in df.columns])


def soft_delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows, those of the keys marked deleted."""
    marked = keys.select(F.col(key).alias("_k")).distinct()
    return df.join(marked, F.col(key) == F.col("_k"), "left").withColumn("is_deleted", F.col("is_deleted") | F.col("_k").isNotNull()).drop("_k")


def restore(df: DataFrame, condition: Column) -> DataFrame:
    """All rows, those of the condition marked not deleted."""
    return df.withColumn("is_deleted", F.col("is_deleted") & ~condition)


def hard_delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows without those of the keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def nested(df: DataFrame, by: list[str], item: Column, name: str) -> DataFrame:
    """One row a group with the sorted list of its items."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias(name))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values held by more than one row."""
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def remap(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replaces a reference by its new key; mapping is (old_id, new_id)."""
    return df.join(mapping, F.col(column) == F.col("old_id"), "left").withColumn(column, F.col("new_id")).drop("old_id", "new_id")
