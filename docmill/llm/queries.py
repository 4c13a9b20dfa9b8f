"""The queries of the training-data operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmill.llm import ann, language, quality, toxicity
from docmill.llm.bpe import digests, encode_column
from docmill.llm.common import crc_mod, cut, delete_path, scratch_path, table, wide_table
from docmill.llm.divergence import divergence
from docmill.llm.embedding_dedup import links
from docmill.llm.jaccard_join import join
from docmill.llm.mixing import blocks, mix, n_words, weights
from docmill.llm.ranked_search import asked_terms, build_index, read_index, search
from docmill.llm.suffix_dedup import remove_repeats
from docmill.llm.token_count import count_tokens
from docmill.llm.token_files import digest, encode_documents, id_type, read_tokens, write_tokens

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def _query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(rest) -> Column:
    """Whether a row is held out; one without an id isn't, but is never learned from either."""
    return F.coalesce(rest, F.lit(False)).alias("held_out")


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document by the 32k SentencePiece model."""
    found = count_tokens(wide_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "n_chunks")


@_query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document by the 50k ranks, and the bytes that the ids decode to, as digests."""
    import public_tokenizers

    return digests(encode_column(wide_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document; learned from the labels outside the held-out fifth."""
    docs, labels = wide_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = toxicity.score(docs, toxicity.fit(docs, known.where(crc_mod("doc_id", 5) != 0)))
    return found.select("doc_id", _held_out(crc_mod("doc_id", 5) == 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95 or more."""
    return links(wide_table(spark, sf_dir, "embeddings"), 0.95)


@_query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all others."""
    return ann.search(wide_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


@_query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every byte of a 200-byte string that starts elsewhere too, from all documents."""
    found = remove_repeats(wide_table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Parameters of the mix: share of the largest entropy, and how often a source may be repeated.
MIX_ENTROPY, MIX_REPEATS = 0.985, 3.0


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block permutations of a mix of the sources near equal weights: a row for each time that a document is taken."""
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "source", n_words().alias("n_tokens"))
    return blocks(mix(counted, F.col("n_tokens"), weights(counted, MIX_ENTROPY, MIX_REPEATS)))


_ORACLE["op7_mixing"] = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
src AS MATERIALIZED (SELECT source, CAST(sum(n) AS DOUBLE) AS tokens FROM docs GROUP BY source HAVING sum(n) > 0),
tot AS MATERIALIZED (SELECT sum(tokens) AS total, ln(CAST(count(*) AS DOUBLE)) * {MIX_ENTROPY} AS goal FROM src),
shares AS MATERIALIZED (SELECT tokens / total AS s, goal FROM src, tot),
entropy(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN h >= goal THEN mid ELSE lo END, CASE WHEN h >= goal THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, goal, ln(sum(pow(s, (lo + hi) / 2))) - sum(pow(s, (lo + hi) / 2) * (lo + hi) / 2 * ln(s)) / sum(pow(s, (lo + hi) / 2)) AS h
        FROM entropy, shares WHERE i < 40 GROUP BY i, lo, hi, goal)),
repeats(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN r > {MIX_REPEATS} THEN mid ELSE lo END, CASE WHEN r > {MIX_REPEATS} THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, max(pow(s, (lo + hi) / 2) / s) / sum(pow(s, (lo + hi) / 2)) AS r
        FROM repeats, shares WHERE i < 40 GROUP BY i, lo, hi)),
t AS (SELECT round(greatest(
    (SELECT CASE WHEN -sum(s * ln(s)) >= max(goal) THEN 1 ELSE (SELECT (lo + hi) / 2 FROM entropy WHERE i = 40) END FROM shares),
    (SELECT CASE WHEN max(1 / s) / count(*) <= {MIX_REPEATS} THEN 0 ELSE (SELECT (lo + hi) / 2 FROM repeats WHERE i = 40) END FROM shares)), 9) AS t),
w AS (SELECT source, CAST(tokens AS BIGINT) AS tokens, round(pow(tokens / total, t) / sum(pow(tokens / total, t)) OVER (), 9) AS weight, total FROM src, tot, t),
plan AS (SELECT source, tokens, CAST(floor(weight * total) AS BIGINT) AS budget FROM w),
dealt AS (SELECT doc_id, d.source, n, budget // tokens AS whole, budget % tokens AS rest FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '1', whole, doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dealt),
taken AS (SELECT doc_id, source, n, CAST(whole + CASE WHEN before < rest AND n > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed),
blocks AS (SELECT *, unnest(range(copies)) AS block FROM taken)
SELECT doc_id, source, n AS n_tokens, copies, block, md5(concat_ws(':', '1', block, doc_id)) AS order_key FROM blocks
"""


@_query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents (word BPE, end id 2) to token files and returns what the files hold."""
    docs = wide_table(spark, sf_dir, "documents")
    path, model = scratch_path(spark, "tokens"), _tokenizer("word_bpe_49k.json")
    encoded, dtype = encode_documents(docs, model, end_id=2), id_type(model)
    write_tokens(encoded, docs, path, parts=int(spark.conf.get("spark.sql.shuffle.partitions")), dtype=dtype)
    found = cut(digest(read_tokens(spark, path), dtype).withColumnRenamed("id", "doc_id"))
    delete_path(spark, path)
    return found


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document; learned outside the held-out third."""
    docs = wide_table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs.where(crc_mod("doc_id", 3) != 1)))
    return found.select("doc_id", _held_out(crc_mod("doc_id", 3) == 1), "lang_pred", "score")


@_query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a Jaccard similarity of 0.85."""
    return join(wide_table(spark, sf_dir, "documents"), 4, 85)


@_query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest-scoring documents of all for each benchmark item."""
    path = scratch_path(spark, "postings")
    build_index(wide_table(spark, sf_dir, "documents"), path)
    found = cut(search(read_index(spark, path), asked_terms(table(spark, sf_dir, "benchmark")), 10))
    delete_path(spark, path)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORACLE["op11_ranked_search"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
t AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w) * docs) // words AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM t JOIN w USING (term) JOIN m USING (r)),
f AS (SELECT item_id, r, CAST(sum(part) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM f JOIN m USING (r) WHERE score > 0 QUALIFY rank <= 10
"""


@_query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document; learned from the labels outside the held-out third."""
    docs, labels = wide_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = quality.score(docs, quality.fit(docs, known.where(crc_mod("doc_id", 3) != 1)))
    return found.select("doc_id", _held_out(crc_mod("doc_id", 3) == 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart in their terms, and the terms that tell each source."""
    return divergence(wide_table(spark, sf_dir, "documents"))


_ORACLE["op13_source_divergence"] = f"""
WITH d AS MATERIALIZED (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN held USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS kept FROM held GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, held.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(gn.total, 0)::HUGEINT + 5 * v.kept) AS p
  FROM g JOIN held USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = held.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (max(total)::HUGEINT + 5 * max(kept)) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their DuckDB SQL."""
    return dict(_ORACLE)
