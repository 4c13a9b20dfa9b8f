"""Source divergence audit by wide term vectors.

One pass over the texts counts terms by language and source before anything
moves. Each term of a language that enough of its documents hold becomes one
row with an array over the language's sources, and higher-order functions of
Spark turn the array into the contributions of all pairs of sources, which are
summed before and after the shuffle. Arithmetic is exact: integers, and
decimals of 38 digits before a division.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docmill.llm.common import cut, slices
from docmill.llm.terms import summed, term_counts
from docmill.operators.lineage import small, spread


def source_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``(lang, source, term, n, df)``: occurrences of each term in each group, and documents of the group that hold it.

    Every group also has a row of a null term, so that groups without terms are
    seen. Nulls count as ''. Terms are runs of Latin letters and characters
    beyond ASCII, A to Z lowered. Counts are added within batches, tasks and
    then by key, so a hot source or term moves as few rows as any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            langs, sources = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
            many = len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy()
            rows, codes, counts, terms = term_counts(b.column(2), False)
            wide = max(len(terms), 1)
            keys = group[rows] * wide + codes
            at, n = summed(keys, counts)
            _, df = summed(keys, np.ones(len(keys), np.int64))
            seen = np.unique(group)
            g = np.concatenate([seen, at // wide])
            named = pa.concat_arrays([pa.nulls(len(seen), pa.string()), terms.take(pa.array(at % wide))])
            zeros = np.zeros(len(seen), np.int64)
            yield pa.record_batch(
                [langs.dictionary.take(pa.array(g // many)), sources.dictionary.take(pa.array(g % many)), named, pa.array(np.concatenate([zeros, n])), pa.array(np.concatenate([zeros, df]))],
                ["lang", "source", "term", "n", "df"],
            )

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))]
    counted = docs.select(*plain).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: Column, total: Column, kept: Column, scale: int, smooth: int) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * kept)), exactly."""
    exact = lambda c: c.cast("decimal(20,0)")
    top = F.lit(scale).cast("decimal(12,0)") * exact(count + smooth)
    return 1 + F.call_function("div", top, exact(total + smooth * kept)).cast("long")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, scale: int = 1_000_000_000, smooth: int = 5, top: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every group of a language and a source.

    A language keeps the terms that at least ``min_docs`` of its documents
    hold; p of a kept term in a group is 1 + floor(scale * (count + smooth) /
    (N + smooth * V)). Part ``pair`` gives each other source of the language
    with the sum of |p - p'| over all kept terms (0 without any), part ``term``
    the ``top`` kept terms that occur in the group with p above the language's,
    by the difference. Ranks go from 1 by value descending, then item by bytes.

    Null languages, sources and texts count as ''; repeated rows count as often
    as they stand; columns of other names are not read; an empty table gives no
    row, a language of one source no pair. A group's task ranks its sources, or
    the first ``top`` of each task before it, never all terms. Sources of one
    language stand in one array, so their number, not that of rows, is bounded
    by a row's size; pairs of sources are what is asked for.
    """
    counted = cut(source_terms(docs, lang, source, text))
    terms = counted.where(F.col("term").isNotNull())
    wide = terms.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    wide = cut(wide.where(F.col("df") >= min_docs).drop("df"))
    sizes = wide.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = wide.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    groups = counted.where(F.col("term").isNull()).select("lang", "source").join(sizes, ["lang", "source"], "left")
    sources = F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))))
    groups = cut(groups.groupBy("lang").agg(sources.alias("sources")).join(langs, "lang", "left").na.fill(0, ["kept", "total"]))

    zero = F.lit(0).cast("long")
    rows = spread(wide).join(small(groups), "lang")  # a row makes a row for each pair of sources
    count = lambda s: F.coalesce(F.try_element_at("counts", s.source), zero)
    rows = rows.withColumn("p", F.transform("sources", lambda s: _share(count(s), s.n, F.col("kept"), scale, smooth)))
    rows = rows.withColumn("q", _share(F.col("n"), F.col("total"), F.col("kept"), scale, smooth))

    later = lambda i: F.slice("p", i + 1, F.size("p"))  # noqa: E731  the sources behind the i-th, from 1
    gap = lambda i: F.transform(later(i), lambda y, j: F.struct((i - 1).alias("a"), (i + j).alias("b"), F.abs(F.element_at("p", i) - y).alias("f")))
    gaps = rows.where(F.size("sources") > 1).select("lang", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("p") - 1), gap))).alias("x"))
    sums = gaps.groupBy("lang", "x.a", "x.b").agg(F.sum("x.f").alias("value"))
    several = groups.where(F.size("sources") > 1)
    other = lambda i: F.transform(F.sequence(i, F.size("sources") - 1), lambda j: F.struct((i - 1).alias("a"), j.alias("b")))
    pairs = several.select("lang", "sources", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("sources") - 1), other))).alias("x"))
    pairs = pairs.select("lang", "x.a", "x.b", F.get("sources", F.col("x.a")).source.alias("sa"), F.get("sources", F.col("x.b")).source.alias("sb"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", zero))
    both = F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    here = F.transform("sources", lambda s, i: F.struct(s.source.alias("source"), count(s).alias("n"), F.get("p", i).alias("p")))
    above = F.filter(here, lambda x: (x.n > 0) & (x.p > F.col("q")))
    told = rows.select("lang", "term", "q", F.explode(above).alias("x"))
    told = told.select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(told.withColumn("rank", place).where(F.col("rank") <= top))
