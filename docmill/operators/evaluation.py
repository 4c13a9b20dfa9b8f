"""Evaluation of answers by alignment of sentences: fixed formulas, JVM expressions only, one narrow pass.

Each sentence of an answer is aligned with that of the context that holds the
largest share of its words, no earlier than the ``back``-th sentence before the
one its predecessor was aligned with (an order bound; None: any sentence).

faithfulness      mean share over the answer's sentences
answer_relevance  share of the question's distinct words that the answer holds
context_relevance mean over the context's sentences of the share of the question's words
context_recall    mean over the reference's sentences of the largest share in one sentence of the context

Words are ASCII letters and digits in lower case, each once a sentence;
sentences end at . ! ? or a line's end, and those without words don't count.
Where there is nothing to take a mean of, the value is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def sentences(text: Column) -> Column:
    """The word sets of a text's sentences, in order."""
    found = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), words)
    return F.filter(found, lambda x: F.size(x) > 0)


def share(a: Column, b: Column) -> Column:
    """Share of a's words that b has; a isn't empty."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def aligned(a: Column, b: Column, back: int | None) -> Column:
    """The shares of the sentences a in the sentences b that they are aligned with."""
    if back is None:
        return F.transform(a, lambda x: F.coalesce(F.array_max(F.transform(b, lambda y: share(x, y))), F.lit(0.0)))

    def step(state: Column, x: Column) -> Column:
        lo = F.greatest(F.lit(0), state.at - back)
        shares = F.transform(b, lambda y, j: F.struct(F.when(j >= lo, share(x, y)).otherwise(-1.0).alias("s"), (-j).alias("j")))
        best = F.array_max(shares)  # of equal shares the earliest
        none = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("j"))
        best = F.coalesce(F.when(best.s > 0, best), F.struct(none.s.alias("s"), (-state.at).alias("j")))
        return F.struct((-best.j).cast("int").alias("at"), F.concat(state.got, F.array(best.s)).alias("got"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<double>").alias("got"))
    return F.aggregate(a, first, step, lambda s: s.got)


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)


def evaluate(rows: DataFrame, question: str = "question", answer: str = "answer", context: str = "context", reference: str | None = None, back: int | None = None) -> DataFrame:
    """All columns of rows and the measures (context_recall with a reference); null texts count as empty ones."""
    rows = rows.withColumns({"_q": words(F.col(question)), "_a": sentences(F.col(answer)), "_c": sentences(F.col(context))})
    asked = F.col("_q")
    some = lambda found: F.when(F.size(asked) > 0, found).otherwise(0.0)
    out = rows.withColumns({
        "faithfulness": _mean(aligned(F.col("_a"), F.col("_c"), back)),
        "answer_relevance": some(share(asked, words(F.col(answer)))),
        "context_relevance": some(_mean(F.transform("_c", lambda y: share(asked, y)))),
    })
    if reference:
        out = out.withColumn("context_recall", _mean(aligned(sentences(F.col(reference)), F.col("_c"), None)))
    return out.drop("_q", "_a", "_c")
