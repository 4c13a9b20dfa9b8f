"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Only DataFrame and SQL functions: each source's share of the tokens is raised to
an exponent t in [0, 1] and the powers are normalised to weights. t = 1 keeps
the shares and t = 0 makes all sources equal; the weights' entropy falls and the
largest repetition (weight times budget over the source's tokens) falls as t
rises, so bisection finds the exponent nearest to 1 that reaches the target
entropy, or the smallest that keeps the repetition limit. A source's budget is
then dealt by block permutations: block b takes the source's documents in an
order of its own, by a hash of seed, block and id: whole blocks first, and of the
last one, in that block's order, what still begins within the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Steps of the bisection; the exponent is then exact to 2^-40.
STEPS = 40
#: Documents of a range of a block's order, about: a task's share of a prefix sum.
RANGE = 2_000


def n_words(text: str = "text") -> Column:
    """Tokens of a document: its words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _powers(shares: Column, t: Column) -> Column:
    """The normalised powers of the shares."""
    p = F.transform(shares, lambda s: F.pow(s, t))
    return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b))


def _entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.ln(w)).otherwise(0.0))


def _bisected(shares: Column, good) -> Column:
    """The bound of [0, 1] between a good exponent and one that isn't; good(weights) holds on one side."""

    def step(s: Column, _: Column) -> Column:
        mid = (s.lo + s.hi) / 2
        left = good(_powers(shares, mid))
        return F.struct(F.when(left, mid).otherwise(s.lo).alias("lo"), F.when(left, s.hi).otherwise(mid).alias("hi"))

    first = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda s: (s.lo + s.hi) / 2)


def weights(tokens: DataFrame, target_entropy: float | None = None, most_repeats: float | None = None, budget_share: float = 1.0) -> DataFrame:
    """``(source, tokens, weight, budget)`` for ``(source, n_tokens)`` rows.

    target_entropy is a share of the largest entropy (ln of the number of
    sources); with most_repeats no source's budget is more than that many times
    its tokens. With both, the exponent is the larger of the two. The total
    budget is budget_share times all tokens. Sources without tokens get nothing;
    a null source is one of its own. Weights are rounded to nine decimals, so
    that budgets do not hang on a last bit.
    """
    by = tokens.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    rows = F.filter(F.array_sort(F.collect_list(F.struct(F.col("tokens"), F.col("source")))), lambda r: r.tokens > 0)
    one = by.agg(rows.alias("rows")).where(F.size("rows") > 0)
    one = one.withColumn("total", F.aggregate("rows", F.lit(0.0), lambda a, r: a + r.tokens))
    one = one.withColumn("shares", F.transform("rows", lambda r: r.tokens / F.col("total")))
    t = F.lit(0.0)
    if target_entropy is None and most_repeats is None:
        t = F.lit(1.0)
    if target_entropy is not None:
        goal = F.ln(F.size("shares").cast("double")) * target_entropy
        t = F.greatest(t, F.when(_entropy(F.col("shares")) >= goal, 1.0).otherwise(_bisected(F.col("shares"), lambda w: _entropy(w) >= goal)))
    if most_repeats is not None:
        worst = lambda w: F.array_max(F.zip_with(w, "shares", lambda a, s: a * budget_share / s))
        fits = worst(_powers(F.col("shares"), F.lit(0.0))) <= most_repeats
        t = F.greatest(t, F.when(fits, 0.0).otherwise(_bisected(F.col("shares"), lambda w: worst(w) > most_repeats)))
    one = one.withColumn("t", F.round(t, 9))
    one = one.withColumn("w", _powers(F.col("shares"), F.col("t")))
    flat = one.select("total", F.posexplode("rows").alias("i", "r"), "w").select("total", "r", F.round(F.get("w", F.col("i")), 9).alias("weight"))
    return flat.select(F.col("r.source").alias("source"), F.col("r.tokens").cast("long").alias("tokens"), "weight", F.floor(F.col("weight") * F.col("total") * budget_share).cast("long").alias("budget"))


def _order_key(seed: int, block: Column, id_: Column) -> Column:
    """By which a block's documents are permuted; a null block or id counts as none."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), id_.cast("string")))


def mix(docs: DataFrame, n_tokens: Column, weighted: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 1, ties: tuple[str, ...] = ()) -> DataFrame:
    """``(id, source, n_tokens, copies)``: how often each document is taken.

    Of a source with budget B and T tokens, every document is taken in b = floor(B
    / T) whole blocks, and once more if it begins before B mod T in the order of
    the last block (by md5 of seed, b and id, then id), the order that blocks
    gives it. Its place there is a prefix
    sum in two steps: sums of ranges of the hash, and a window within a range,
    so that a source with any share of all rows is dealt to as many tasks as it
    has ranges. Documents without tokens go with the whole blocks alone.
    Repeated rows are documents of their own, each with its row's result (the
    order of equal ids among each other is free, or by the columns ``ties``,
    which then come along).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_tokens.alias("n"), *ties)
    counted = rows.groupBy("source").agg(F.count("*").alias("docs"))
    plan = weighted.join(counted.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "inner").select(F.col("source").alias("s"), "tokens", "budget", F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE)).alias("ranges"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumn("key", _order_key(seed, F.expr("budget div tokens"), F.col("id"))).withColumn("at", F.conv(F.substring("key", 1, 7), 16, 10).cast("long"))
    rows = rows.withColumn("range", F.floor(F.col("at") * F.col("ranges") / F.lit(1 << 28)))
    same = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "range").agg(F.sum("n").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(same), F.lit(0)))
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), "before")
    within = Window.partitionBy("source", "range").orderBy("key", "id", *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & F.col("range").eqNullSafe(F.col("r")), "left")
    whole = F.expr("budget div tokens")
    more = (F.col("before") + F.col("inside") < F.expr("budget % tokens")) & (F.col("n") > 0)
    copies = F.coalesce(whole + F.when(more, 1).otherwise(0), F.lit(0)).cast("long")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("n").alias("n_tokens"), copies.alias("copies"), *ties)


def blocks(mixed: DataFrame, id_col: str = "doc_id", seed: int = 1) -> DataFrame:
    """One row for each copy: ``block`` from 0 and ``order_key``, by which a source's documents of a block are permuted (ties by id)."""
    rows = mixed.where("copies > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.withColumn("order_key", _order_key(seed, F.col("block"), F.col(id_col)))
