"""Trees of (id, parent) rows: closures, ancestor chains, checks and subtree aggregates.

Chains are climbed by pointer doubling: every node has a pointer some steps up,
and each round follows all pointers by one self-join, so that a tree of depth d
takes log2(d) joins of its nodes, whatever its width. A loop in the data ends
after as many rounds as its nodes could need. ``key`` has no repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmill.operators.lineage import cut


def _climb(state: DataFrame, **followed: Column) -> DataFrame:
    """Doubles the pointers ``jump`` of ``(id, jump, ...)`` until none is left or a loop must hold the rest.

    followed gives the columns after a row's pointer is followed; ``_id`` and
    the like are those of the row it points to (null: none).
    """
    reached = 1
    while True:
        for _ in range(2):  # two rounds for each checkpoint
            there = state.select([F.col(c).alias(f"_{c}") for c in state.columns])
            state = state.join(there, F.col("jump") == F.col("_id"), "left").select("id", *[c.alias(n) for n, c in followed.items()])
        state, reached = cut(state), reached * 4
        left, nodes = state.agg(F.count("jump"), F.count("*")).first()
        if not left or reached > nodes:
            return state


def descendants(nodes: DataFrame, root, key: str = "folder_id", parent: str = "parent_id", depth: int | None = None) -> DataFrame:
    """``(key, depth)``: the root (depth 0) and all below it, to any depth or down to ``depth``."""
    top = F.col(key) == root
    state = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.when(~top, F.col(parent)).alias("jump"), F.lit(1).alias("dist"), F.when(top, F.lit(0)).alias("hit"))
    hit = F.coalesce("hit", F.col("dist") + F.col("_hit"))
    found = _climb(state, jump=F.when(hit.isNull(), F.col("_jump")), dist=F.col("dist") + F.col("_dist"), hit=hit)
    found = found.where("hit is not null").select(F.col("id").alias(key), F.col("hit").alias("depth"))
    return found if depth is None else found.where(F.col("depth") <= depth)


def ancestors(nodes: DataFrame, key: str = "folder_id", parent: str = "parent_id", depth: int | None = None) -> DataFrame:
    """``(key, ancestor, hops)``: every node with itself (0 hops) and all above it (up to ``depth`` hops; the least, in a loop)."""
    rows = nodes.where(F.col(key).isNotNull())
    chain = rows.select(F.col(key).alias("id"), F.col(key).alias("at"), F.lit(0).alias("hops"))
    step = rows.where(F.col(parent).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("at"))  # nodes with those 2^k hops above
    absent = step.select(F.col("at").alias("id")).distinct().join(rows.select(F.col(key).alias("id")), "id", "left_anti")  # a parent that is no node is an ancestor too
    absent = absent.select("id", F.col("id").alias("at"), F.lit(0).alias("hops"))
    most, hops = rows.count() if depth is None else depth, 1
    while hops <= most:
        below, above = step.toDF("low", "mid"), chain.unionByName(absent).toDF("mid", "at", "more")
        further = below.join(above, "mid").select(F.col("low").alias("id"), "at", (F.col("more") + hops).alias("hops"))
        chain = cut(chain.unionByName(further).groupBy("id", "at").agg(F.min("hops").alias("hops")))
        step = cut(below.join(step.toDF("mid", "at"), "mid").select(F.col("low").alias("id"), "at"))
        hops *= 2
        if step.isEmpty():
            break
    found = chain.select(F.col("id").alias(key), F.col("at").alias("ancestor"), "hops")
    return found if depth is None else found.where(F.col("hops") <= depth)


def would_loop(nodes: DataFrame, moved, target, key: str = "folder_id", parent: str = "parent_id") -> DataFrame:
    """One row: whether moving a node under the target would make a loop (the target is in its subtree)."""
    return descendants(nodes, moved, key, parent).where(F.col(key) == target).agg((F.count("*") > 0).alias("would_loop"))


def visible(nodes: DataFrame, accessible: DataFrame, key: str = "folder_id", parent: str = "parent_id") -> DataFrame:
    """Accessible nodes all of whose ancestors are accessible; what hangs on a loop or on a parent that isn't there is not visible."""
    open_ = accessible.select(F.col(key).alias("id"), F.lit(True).alias("ok"))
    state = nodes.select(F.col(key).alias("id"), F.col(parent).alias("jump")).join(open_, "id", "left")
    state = state.select("id", F.when(F.col("ok"), F.col("jump")).alias("jump"), F.coalesce("ok", F.lit(False)).alias("ok"))
    ok = F.col("ok") & (F.col("jump").isNull() | F.coalesce("_ok", F.lit(False)))
    found = _climb(state, jump=F.when(ok, F.col("_jump")), ok=ok).where("ok and jump is null")
    return accessible.join(found.select(F.col("id").alias(key)), key, "left_semi")


def roots(nodes: DataFrame, parent: str = "parent_id", of=None) -> DataFrame:
    """The roots, or the direct children of a node."""
    return nodes.where(F.col(parent).isNull() if of is None else F.col(parent) == of)


def subtree_counts(nodes: DataFrame, members: DataFrame, member_node: str, key: str = "dept_id", parent: str = "parent_id") -> DataFrame:
    """``(key, members)``: members of each node's whole subtree; counted by node before the closure join."""
    own = members.groupBy(F.col(member_node).alias(key)).agg(F.count("*").alias("own"))
    total = ancestors(nodes, key, parent).join(own, key).groupBy("ancestor").agg(F.sum("own").alias("members"))
    return nodes.select(key).join(total.withColumnRenamed("ancestor", key), key, "left").select(key, F.coalesce("members", F.lit(0)).alias("members"))


def children_lists(nodes: DataFrame, key: str, parent: str = "parent_id") -> DataFrame:
    """``(parent, children)``: the sorted children of every node that has some."""
    return nodes.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.sort_array(F.collect_list(key)).alias("children"))


def orphans(nodes: DataFrame, key: str, parent: str = "parent_id") -> DataFrame:
    """Nodes whose parent isn't there."""
    known = nodes.select(F.col(key).alias("_p"))
    return nodes.where(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("_p"), "left_anti")
