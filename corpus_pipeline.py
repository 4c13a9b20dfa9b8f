"""A training corpus from ``documents``: languages, near duplicates, repeated passages, mixture, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docmill.llm import language
from docmill.llm.bpe import digests, encode_column
from docmill.llm.common import cut, delete_path, scratch_path, small_batches, table
from docmill.llm.jaccard_join import join
from docmill.llm.mixing import mix, n_words, weights
from docmill.llm.suffix_dedup import remove_repeats

#: What stages know of documents; other columns come along.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and similarity, in per cent, of near duplicates.
WORDS, PERCENT = 5, 80
#: Bytes of a repeated passage.
PASSAGE = 200
#: Share of the sources' largest entropy, and how often a source is repeated at most.
ENTROPY, REPEATS = 0.985, 3.0


def keeps_columns(stage):
    """A stage that sees the columns of documents under their names and all others under names of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        inner = [c if c in COLUMNS else f"docmill_extra_{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(inner).toDF(*names)

    return run


@keeps_columns
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language: null ones and those without a letter. The language found replaces a null lang.

    The letter test alone rejects; the classifier only names. Where no row has a
    lang, nothing can be learned and lang stays null.
    """
    model = language.fit(docs)
    if model is None:
        return language.lettered(docs)
    tagged = language.tag(docs, model, name="_lang", score="_score").where("_score > 0")  # 0: no letter; "und" may be a label
    return tagged.withColumn("lang", F.coalesce("lang", "_lang")).select(docs.columns)


@keeps_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (connected links) the document of the smallest id stays, once.

    Rows are told apart by id and text: texts that share an id are documents of
    their own, and a row without an id stays where no other row covers it. Ids
    come before none. A wordless row without an id is covered by nothing.
    """
    lone = F.col("doc_id").isNull() & (n_words() == 0)
    keyed = docs.where(~lone).withColumn("_key", F.xxhash64("doc_id", "text"))
    none = F.lit(None).cast("long")
    found = join(keyed, WORDS, PERCENT, id_col="_key").select("_key", "component_id", none.alias("doc_id"))
    rows = found.unionByName(keyed.select("_key", none.alias("component_id"), "doc_id"))
    rows = rows.groupBy("_key").agg(F.max("component_id").alias("component_id"), F.max("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    kept = rows.groupBy("component_id").agg(first.alias("m")).select("m._key")
    kept = keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)
    return kept.unionByName(docs.where(lone))


@keeps_columns
def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of repeated passages (and what they leave of a character); a document of which nothing is left goes."""
    out = remove_repeats(docs, PASSAGE, as_text=True).where((F.col("kept") != "") | (F.col("n_removed") == 0))
    out = out.withColumn("n_chars", F.length("kept").cast("long")).withColumn("text", F.col("kept"))
    return out.select(docs.columns)


@keeps_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mixture says: rows of a source above its budget go, others repeat.

    Every row counts on its own, also one without an id or with another's id;
    rows equal in id, source and text are dealt the copies of all of them. Rows
    without an id are ordered by their text.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "source", "text"))
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    counted = keyed.select(id_.alias("_id"), "source", "_key", n_words().alias("n"))
    plan = weights(counted.withColumnRenamed("n", "n_tokens"), ENTROPY, REPEATS)
    each = mix(counted, F.col("n"), plan, id_col="_id", ties=("_key",)).groupBy("_key").agg(F.sum("copies").alias("sum"), F.count("*").alias("rows"))
    each = cut(each.where("sum > 0").select("_key", F.expr("sum div rows").alias("_copies"), F.expr("sum % rows").alias("_more")))
    joined = keyed.join(each, "_key")
    taken = joined.where("_more = 0")
    torn = [r[0] for r in each.where("_more > 0").select("_key").collect()]  # one for each source at most: equal rows that its budget ends among
    if torn:
        nth = F.row_number().over(Window.partitionBy("_key").orderBy("lang", "n_chars"))
        some = joined.where(F.col("_key").isin(torn)).withColumn("_copies", F.col("_copies") + (nth <= F.col("_more")).cast("long"))
        taken = taken.unionByName(some.where("_copies > 0"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every row and the bytes they decode to, as digests; coded at once, in small batches, as only digests need storing."""
    return cut(digests(encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_passages),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: SQL can express neither the classifier nor the merges; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    found = STAGES[-1][1](spark, docs, sf_dir)
    delete_path(spark, before)
    return found
