"""Labels of trees: a node's label begins with its parent's, so a subtree is one range of labels.

A label is the path of ids from the root, each as 16 hexadecimal digits (or as
an order key's), so labels sort in preorder. Subtrees, ancestors and cycles are
then string comparisons: a filter on a stored, sorted column reads only the row
groups of that range, and no tree is climbed. A move rewrites the labels of the
moved subtree only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmill.operators.lineage import cut

#: Digits of one step of a path, and what sorts behind all of them.
STEP, BEHIND = 16, "g"


def step(id_: Column) -> Column:
    """An id's place in a path: 16 hexadecimal digits that sort as the ids do."""
    return F.lower(F.lpad(F.hex(id_.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), STEP, "0"))


def labelled(nodes: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """All columns of nodes and ``label``; null for nodes on a loop or below one. A parent that isn't there makes a root.

    Paths double in each round, one join each, so rounds are the logarithm of
    the depth; what no longer becomes less is on loops. Ids are unique integers.
    """
    known = nodes.select(F.col(key).alias("_p"))
    state = nodes.select(F.col(key).alias("id"), F.col(parent).alias("up")).where("id is not null")
    state = state.join(known, F.col("up") == F.col("_p"), "left").select("id", F.col("_p").alias("up"), step(F.col("id")).alias("label"))
    state = cut(state)
    left = state.where("up is not null").count()
    while left:
        above = state.select(F.col("id").alias("_a"), F.col("up").alias("_u"), F.col("label").alias("_l"))
        climbed = state.where("up is not null").join(above, F.col("up") == F.col("_a")).select("id", F.col("_u").alias("up"), F.concat("_l", "label").alias("label"))
        state = cut(state.where("up is null").unionByName(climbed))
        before, left = left, state.where("up is not null").count()
        if left == before:
            break
    found = state.select(F.col("id").alias("_id"), F.when(F.col("up").isNull(), F.col("label")).alias("label"))
    return nodes.drop("label").join(found, F.col(key) == F.col("_id"), "left").drop("_id")


def store(rows: DataFrame, path: str) -> None:
    """Writes labelled nodes in the order of their labels, so that a subtree lies in few files and row groups."""
    rows.repartitionByRange("label").sortWithinPartitions("label").write.mode("overwrite").parquet(path)


def inside(label: str, itself: bool = True) -> Column:
    """Whether a node is in the subtree of this label: a range that reaches the scan."""
    low = F.col("label") >= label if itself else F.col("label") > label
    return low & (F.col("label") < label + BEHIND)


def label_of(rows: DataFrame, key: str, value) -> str:
    """One node's label; fails if the node isn't there or is on a loop."""
    found = rows.where(F.col(key) == value).select("label").head()
    if found is None or found.label is None:
        raise ValueError(f"{key} {value} has no label")
    return found.label


def descendants(rows: DataFrame, value, key: str = "id") -> DataFrame:
    """The nodes below one, with ``depth`` (1 for children)."""
    label = label_of(rows, key, value)
    return rows.where(inside(label, False)).withColumn("depth", ((F.length("label") - len(label)) / STEP).cast("int"))


def ancestors(rows: DataFrame, value, key: str = "id") -> DataFrame:
    """The nodes above one, with ``hops`` (1 for the parent): rows whose label is a part of its path."""
    label = label_of(rows, key, value)
    above = [label[:n] for n in range(STEP, len(label), STEP)]
    return rows.where(F.col("label").isin(above)).withColumn("hops", ((len(label) - F.length("label")) / STEP).cast("int"))


def subtree_sums(rows: DataFrame, value: Column, key: str = "id") -> DataFrame:
    """``(key, total)``: the sum of a value over each node's subtree. Every node counts once for each node of its path, added up before it moves."""
    depth = (F.length("label") / STEP).cast("int")
    path = F.transform(F.sequence(F.lit(1), depth), lambda n: F.substring(F.col("label"), F.lit(1), n * STEP))
    sums = rows.where("label is not null").select(F.explode(path).alias("_l"), value.alias("_v")).groupBy("_l").agg(F.sum("_v").alias("total"))
    return rows.join(sums, F.col("label") == F.col("_l")).select(key, "total")


def moved(rows: DataFrame, value, to, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """All nodes after a node has got another parent (None: it becomes a root); a move below itself fails.

    Only the subtree's labels change: its path's beginning is exchanged.
    """
    old = label_of(rows, key, value)
    base = "" if to is None else label_of(rows, key, to)
    if base.startswith(old):
        raise ValueError(f"{key} {value} can't be moved below itself")
    under = F.coalesce(inside(old), F.lit(False))
    label = F.when(under, F.concat(F.lit(base), F.substring(F.col("label"), F.lit(len(old) - STEP + 1), F.length("label")))).otherwise(F.col("label"))
    return rows.withColumns({parent: F.when(F.col(key) == value, F.lit(to).cast("long")).otherwise(F.col(parent)), "label": label})
