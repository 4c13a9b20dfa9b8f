"""Retrieval for all questions at once, and full text from an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmill.functions import outline
from docmill.operators import access as A, ingest as I, knn, relational as R
from docmill.operators.journal import UploadJournal
from docmill.operators.lineage import cut, delete, scratch, spread
from docmill.operators.text_index import STOP_WORDS, TextIndex
from docmill.plans.proxies import oracle as o
from docmill.plans.registry import query
from docmill.sources import files
from docmill.sources.collection import Collection

#: User turns as questions of an account, embedded offline; conversations have fewer than 1,000 turns.
_QUESTIONS = r"""qt AS (SELECT conv_id * 1000 + turn AS question_id, conv_id % 150 + 1 AS account_id, text FROM conversations WHERE role = 'user'),
qw AS (SELECT question_id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 AS s FROM (SELECT question_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM qt)),
qc AS (SELECT question_id, s, CAST(count(*) AS DOUBLE) AS n FROM qw GROUP BY 1, 2), qm AS (SELECT question_id, map(list(s), list(n)) AS m FROM qc GROUP BY 1),
q AS (SELECT question_id, account_id, list_transform(range(64), lambda i: coalesce(m[i], CAST(0 AS DOUBLE))) AS v FROM qt JOIN qm USING (question_id)),
k AS MATERIALIZED (SELECT chunk_id, doc_id, CAST(embedding AS DOUBLE[]) AS e FROM p_chunks)"""

#: What each account may see: by scope or an override for it or one of its roles, unless it or one of its roles is denied.
_VISIBLE = """sub AS (SELECT account_id, 'account' AS subject_type, account_id AS subject_id FROM p_accounts UNION ALL SELECT account_id, 'role', role_id FROM p_account_roles),
acl AS (SELECT account_id, doc_id, bool_or(precedence = 'deny') AS shut, bool_or(precedence = 'override') AS opened FROM sub JOIN p_document_permissions USING (subject_type, subject_id) GROUP BY 1, 2),
vis AS MATERIALIZED (SELECT a.account_id, d.doc_id FROM p_accounts a CROSS JOIN p_documents d LEFT JOIN acl ON acl.account_id = a.account_id AND acl.doc_id = d.doc_id
  WHERE a.account_id IN (SELECT account_id FROM qt) AND NOT a.is_deleted AND NOT d.is_deleted AND NOT coalesce(shut, false) AND (coalesce(opened, false) OR access_scope = 'company'
    OR (access_scope = 'department' AND (a.department_id IS NULL OR d.department_id = a.department_id)) OR (access_scope = 'personal' AND uploader_id = a.account_id)))"""
_ACL = "p_chunks p_documents p_document_permissions p_accounts p_account_roles"
_HITS = f"WITH {_QUESTIONS}, {_VISIBLE}, h AS (SELECT question_id, chunk_id, list_cosine_similarity(v, e) AS score FROM q JOIN vis USING (account_id) JOIN k USING (doc_id)), r AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM h QUALIFY rank <= 5)"


def _questions(t) -> DataFrame:
    turns = t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), (F.col("conv_id") % 150 + 1).alias("account_id"), "text")
    vectors = files.hashing_embedding(turns, "question_id", "text").select("question_id", F.col("embedding").alias("vector"))
    return turns.select("question_id", "account_id").join(vectors, "question_id")


def permitted(t, k: int = 5) -> DataFrame:
    """The k hits of each question among what its account may see."""
    accounts = A.account_keys(R.base_scan(t("p_accounts")), t("p_account_roles"))
    keys = A.document_keys(R.base_scan(t("p_documents")), t("p_document_permissions"))
    chunks = t("p_chunks").join(keys, "doc_id").select("chunk_id", F.col("embedding").alias("vector"), "keys", "denied")
    return knn.nearest(_questions(t).join(accounts, "account_id"), chunks, k)


@query("r10_questions_topk", o("p_chunks", f"WITH {_QUESTIONS} SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY list_cosine_similarity(v, e) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(list_cosine_similarity(v, e), 6) AS score FROM q CROSS JOIN k WHERE list_cosine_similarity(v, e) >= 0.1 QUALIFY rank <= 5"))
def _(t):
    anyone = F.array(F.lit("company"))
    chunks = t("p_chunks").select("chunk_id", F.col("embedding").alias("vector"), anyone.alias("keys"), F.array().cast("array<string>").alias("denied"))
    hits = knn.nearest(_questions(t).select("question_id", "vector", anyone.alias("keys")), chunks, threshold=0.1)
    return hits.withColumn("score", F.round("score", 6))


@query("r11_questions_permitted", o(_ACL, f"{_HITS} SELECT question_id, rank, chunk_id, score FROM r"))
def _(t):
    return permitted(t).withColumn("score", F.round("score", 6))


@query("r18_questions_answered", o(_ACL, f"""{_HITS}, w AS (SELECT question_id, string_agg('- ' || left(text, 200), chr(10) ORDER BY rank) AS context, list(DISTINCT doc_id ORDER BY doc_id) AS sources FROM r JOIN k USING (chunk_id) JOIN documents USING (doc_id) GROUP BY 1)
  SELECT question_id, coalesce(context, '{knn.NO_CONTEXT}') AS context, coalesce(sources, []) AS sources FROM qt LEFT JOIN w USING (question_id)"""))
def _(t):
    texts = t("p_chunks").select("chunk_id", "doc_id").join(t("documents").select("doc_id", F.left("text", F.lit(200)).alias("text")), "doc_id")
    turns = t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"))
    return knn.answers(turns, permitted(t), texts)


def _stem(w: str) -> str:
    """DuckDB SQL of text_index.bare and singular."""
    one = f"CASE WHEN regexp_matches({w}, '[^aeiou]ies$') THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, '(ss|x|ch|sh|zz)es$') THEN regexp_replace({w}, 'es$', '') WHEN regexp_matches({w}, '[^su]s$') AND length({w}) > 3 THEN regexp_replace({w}, 's$', '') ELSE {w} END"
    return f"(SELECT CASE WHEN regexp_matches(x, '^.*[aeiouy].*[a-z]ing$') AND length(x) > 5 THEN regexp_replace(x, 'ing$', '') WHEN regexp_matches(x, '^.*[aeiouy].*[a-z]ed$') AND length(x) > 4 THEN regexp_replace(x, 'ed$', '') ELSE x END FROM (SELECT {one} AS x))"


_POSTINGS = f"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
p AS MATERIALIZED (SELECT doc_id, pos, {_stem('word')} AS term FROM x WHERE word NOT IN ({', '.join(repr(s) for s in STOP_WORDS)}))"""


def _indexed(t, ask) -> DataFrame:
    """The answer of an index of all documents that stands while it is asked; half of them come by a later addition."""
    docs, path = spread(t("documents").select("doc_id", "text")), scratch(t.spark, "text-index")
    index = TextIndex(t.spark, path)
    index.add(docs.where("doc_id % 2 = 0"), "doc_id", "text")
    index.add(docs.where("doc_id % 2 = 1"), "doc_id", "text")
    found = cut(ask(index))
    delete(t.spark, path)
    return found.withColumnRenamed("id", "doc_id")


@query("r15_index_all_terms", f"WITH {_POSTINGS} SELECT doc_id FROM p WHERE term IN ('licens', 'license') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def _(t):
    return _indexed(t, lambda index: index.all_of("Licensed by the licenses"))


@query("r15_index_phrase", f"WITH {_POSTINGS} SELECT a.doc_id, CAST(count(*) AS INTEGER) AS times FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 AND a.term = 'licens' AND b.term = 'cc' GROUP BY 1")
def _(t):
    return _indexed(t, lambda index: index.phrase("Licensed under CC"))


_INDEX_BM25 = f"""WITH {_POSTINGS}, n AS (SELECT doc_id, count(pos) AS n FROM documents LEFT JOIN p USING (doc_id) GROUP BY 1), s AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(n) AS mean FROM n),
tf AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM p WHERE term IN ('apache', 'license', 'releas') GROUP BY 1, 2), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY 1),
b AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM tf JOIN df USING (term) JOIN n USING (doc_id), s GROUP BY 1)
SELECT doc_id, round(score, 9) AS score FROM b"""


@query("r16_index_bm25", _INDEX_BM25)
def _(t):
    return _indexed(t, lambda index: index.bm25("Apache licenses released")).withColumn("score", F.round("score", 9))


@query("r16_index_best", f"{_INDEX_BM25} ORDER BY b.score DESC, doc_id LIMIT 25")
def _(t):
    return _indexed(t, lambda index: index.bm25("Apache licenses released", 25, first_cells=1)).withColumn("score", F.round("score", 9))


@query("s15_collection_versions", o("p_chunks", "SELECT chunk_id AS point_id, CASE WHEN chunk_id % 5 = 0 THEN 'again' ELSE 'first' END AS batch, CAST(label AS VARCHAR) AS label, round(CAST(embedding[1] AS DOUBLE), 6) AS first_number FROM p_chunks WHERE label <> 2 AND chunk_id % 11 <> 3"))
def _(t):
    """Points put in twice, deleted by payload and by id, and compacted: what the last version holds."""
    path = scratch(t.spark, "collection")
    held = Collection(t.spark, path, 64)
    points = lambda batch: t("p_chunks").select(F.col("chunk_id").alias("point_id"), "embedding", F.create_map(F.lit("batch"), F.lit(batch), F.lit("label"), F.col("label").cast("string")).alias("payload"))
    held.put(points("first"))
    held.put(points("again").where("point_id % 5 = 0"))
    held.delete_where({"label": "2"})
    held.compact(held.delete(t("p_chunks").where("chunk_id % 11 = 3").select("chunk_id")))
    found = cut(held.read().select("point_id", F.col("payload.batch").alias("batch"), F.col("payload.label").alias("label"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_number")))
    delete(t.spark, path)
    return found


_DOTTED = r"'^(\d+(?:\.\d+)*)\.?\s+(\S.{0,80})$'"
_SECTIONS = rf"""WITH RECURSIVE d AS (SELECT conv_id, string_agg(repeat('#', CAST(1 + turn % 3 AS INTEGER)) || ' ' || left(replace(text, chr(10), ' '), 30) || chr(10) || text, chr(10) ORDER BY turn) AS doc FROM conversations GROUP BY 1),
l AS (SELECT conv_id, unnest(string_split(doc, chr(10))) AS raw, unnest(range(len(string_split(doc, chr(10))))) AS line FROM d), s AS (SELECT *, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') AS t FROM l),
h AS MATERIALIZED (SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY line) AS section,
  CASE WHEN regexp_matches(t, '^#{{1,6}}\s+.+') THEN length(regexp_extract(t, '^(#{{1,6}})', 1)) WHEN regexp_matches(t, {_DOTTED}) THEN len(string_split(regexp_extract(t, {_DOTTED}, 1), '.')) ELSE 1 END AS level,
  CASE WHEN regexp_matches(t, '^#{{1,6}}\s+.+') THEN regexp_extract(t, '^#{{1,6}}\s+(.+)', 1) WHEN regexp_matches(t, {_DOTTED}) THEN regexp_extract(t, {_DOTTED}, 2) ELSE t END AS title
  FROM s WHERE regexp_matches(t, '^#{{1,6}}\s+.+') OR regexp_matches(t, {_DOTTED}) OR (t <> '' AND length(t) <= 80 AND upper(t) = t AND regexp_matches(t, '\p{{L}}') AND NOT regexp_matches(t, '[.!?]$'))),
p AS MATERIALIZED (SELECT h.conv_id, h.section, h.line, h.level, h.title, (SELECT max(o.section) FROM h o WHERE o.conv_id = h.conv_id AND o.section < h.section AND o.level < h.level) AS parent FROM h),
up AS (SELECT conv_id, section, title AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.conv_id, p.section, up.path || ' > ' || p.title FROM up JOIN p ON p.conv_id = up.conv_id AND p.parent = up.section),
w AS (SELECT s.conv_id, (SELECT max(section) FROM h WHERE h.conv_id = s.conv_id AND h.line <= s.line) AS section, s.line, len(regexp_extract_all(raw, '\S+')) AS n FROM s)"""
_SECTION_ROWS = """SELECT p.conv_id, CAST(p.section AS BIGINT) AS section, CAST(p.parent AS BIGINT) AS parent, CAST(p.level AS BIGINT) AS level, CAST(row_number() OVER (PARTITION BY p.conv_id, p.parent ORDER BY p.section) - 1 AS BIGINT) AS sibling, path,
  CAST(coalesce((SELECT sum(n) FROM w WHERE w.conv_id = p.conv_id AND w.section = p.section AND w.line > p.line), 0) AS BIGINT) AS words FROM p JOIN up USING (conv_id, section)"""


def _outlined(t) -> DataFrame:
    """Conversations as documents: each turn below a heading of one of three levels."""
    heading = F.concat(F.repeat(F.lit("#"), (1 + F.col("turn") % 3).cast("int")), F.lit(" "), F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(30)))
    part = F.concat(heading, F.lit("\n"), "text")
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x.part), "\n").alias("text"))


@query("r14_outline", f"{_SECTIONS} {_SECTION_ROWS}")
def _(t):
    words = F.regexp_count("text", F.lit(r"\S+")).cast("long")
    return outline.section_rows(spread(_outlined(t)), "conv_id", "text").select("conv_id", "section", "parent", "level", "sibling", F.array_join("path", " > ").alias("path"), words.alias("words"))


def _counted(texts: list) -> list:
    """Stands in for an embedding service."""
    return [[float(len(x.split())), float(len(x))] for x in texts]


@query("r26_reembedded", """SELECT doc_id, 'completed' AS status, CAST(count(*) FILTER (WHERE NOT (doc_id % 10 = 0 AND last)) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE doc_id % 10 = 0 AND last) AS BIGINT) AS embedded
  FROM (SELECT doc_id, unnest([false, true]) AS last FROM documents WHERE regexp_matches(text, '\\S')) GROUP BY doc_id""")
def _(t):
    """Each document as two chunks, of which the second one of every tenth document has changed."""
    texts = t("documents").select("doc_id", F.concat(F.lit("one two three four. "), F.col("doc_id").cast("string"), F.lit(" six seven eight.")).alias("text")).join(t("documents").where(F.col("text").rlike(r"\S")).select("doc_id"), "doc_id", "left_semi")
    stored, _ = I.ingest(texts, "doc_id", "text", _counted, 2, 4, 0)
    now = texts.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    _, status = I.reingest(cut(stored), now, "doc_id", "text", _counted, 2, 4, 0)
    return status.select("doc_id", "status", "kept", "embedded")


@query("r21_durable_uploads", """SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS attempt, CASE WHEN NOT regexp_matches(text, '\\S') OR contains(text, 'license') THEN 'failed' ELSE 'completed' END AS status FROM documents""")
def _(t):
    """All documents in two runs of one journal, the first of which sees a third of them."""
    path = scratch(t.spark, "journal")
    docs = spread(t("documents").select("doc_id", "text"))
    journal = UploadJournal(t.spark, path)
    embed = lambda texts: [None if "license" in x else [float(len(x)), 1.0] for x in texts]
    journal.run(docs.where("doc_id % 3 = 0"), "text", embed, 2)
    journal.run(docs, "text", embed, 2)
    found = cut(journal.status(docs).select("doc_id", "attempt", "status"))
    delete(t.spark, path)
    return found
