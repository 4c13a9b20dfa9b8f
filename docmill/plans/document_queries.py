"""Document pipeline, retrieval, chat and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions.chunking import chunks
from docmill.operators import access as A, relational as R, retrieval as V
from docmill.operators.lineage import spread
from docmill.plans.proxies import oracle as o
from docmill.plans.registry import query
from docmill.sources import files
from docmill.streaming import audit

_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM p_chunks WHERE chunk_id = 0), c AS (SELECT chunk_id, doc_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS score FROM p_chunks)"


def _texts(t):
    """The documents' texts, over all cores."""
    return spread(t("documents").select("doc_id", "text"))


def _asked(t):
    return t("p_chunks").where("chunk_id = 0")


@query("s7_text_metadata", r"SELECT doc_id, greatest(1, w // 300) AS pages, w AS words, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM (SELECT *, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS w FROM documents)")
def _(t):
    return files.text_metadata(t("documents"), "text").select("doc_id", "pages", "words", "chars", "lines")


@query("s8_supported_types", "SELECT page_id, url LIKE '%.html' OR url LIKE '%.md' AS supported FROM pages")
def _(t):
    return t("pages").select("page_id", (F.endswith("url", F.lit(".html")) | F.endswith("url", F.lit(".md"))).alias("supported"))


@query("s9_content_addressed", "SELECT md5(text) AS name, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    return files.content_addressed(t("documents"), "doc_id", "text")


@query("s10_file_validation", "SELECT doc_id, n_chars <= 5000 AND lang IN ('en', 'de') AS ok FROM documents")
def _(t):
    return files.validate(t("documents"), "n_chars", "lang", 5000, ["en", "de"]).select("doc_id", "ok")


@query("s15_vector_dimension", o("p_chunks", "SELECT chunk_id, len(embedding) = 64 AS ok FROM p_chunks"))
def _(t):
    return t("p_chunks").select("chunk_id", (F.size("embedding") == 64).alias("ok"))


@query("s18_csv_cells", """SELECT p_partkey, CASE WHEN contains(c, ',') THEN '"' || c || '"' ELSE c END AS cell FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', ', ') ELSE p_name END AS c FROM part)""")
def _(t):
    c = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(", "))).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", files.csv_cell(c).alias("cell"))


@query("r1_word_spans", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, CAST(list_sum(list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w))) AS BIGINT) AS word_chars FROM documents")
def _(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t("documents").select("doc_id", F.size(words).cast("long").alias("words"), F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"))


_WINDOWS = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text,'\S+') AS ws FROM documents),
b AS (SELECT doc_id, len(ws) AS n, CASE WHEN len(ws)>240 THEN list_append(list_filter(range(1,len(ws)), lambda i: regexp_matches(ws[i],'[.!?]$')), len(ws)) ELSE [len(ws)] END AS bps FROM w),
t AS (SELECT doc_id, n, bps, 0 AS seq, CAST(0 AS BIGINT) AS s, coalesce(list_max(list_filter(bps, lambda x: x>=156 AND x<=least(240,n))), least(240,n)) AS e FROM b WHERE n>0
UNION ALL SELECT doc_id, n, bps, seq+1, e-48, coalesce(list_max(list_filter(bps, lambda x: x>=e-48+156 AND x<=least(e-48+240,n))), least(e-48+240,n)) FROM t WHERE e<n)
"""


@query("r4_chunk_windows", _WINDOWS + "SELECT doc_id, CAST(seq AS BIGINT) AS sequence, CAST(s AS BIGINT) AS start_token, CAST(e AS BIGINT) AS end_token FROM t")
def _(t):
    return chunks(_texts(t), "doc_id", "text").select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("sequence", "start_token", "end_token")])


@query("r7_chunk_text", _WINDOWS + r"SELECT doc_id, CAST(seq AS BIGINT) AS sequence, CAST(e - s AS BIGINT) AS token_count, md5(list_aggregate(regexp_extract_all(text, '\S+')[s + 1:e], 'string_agg', ' ')) AS words_md5 FROM t JOIN documents USING (doc_id)")
def _(t):
    c = chunks(_texts(t), "doc_id", "text")
    return c.select("doc_id", F.col("sequence").cast("long").alias("sequence"), (F.col("end_token") - F.col("start_token")).cast("long").alias("token_count"), F.md5(F.regexp_replace("text", r"\s+", " ").cast("binary")).alias("words_md5"))


@query("r9_hashing_embedder", r"""WITH w AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 AS s FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents)),
c AS (SELECT doc_id, s, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY 1, 2), v AS (SELECT doc_id, map(list(s), list(n)) AS m, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id)
SELECT doc_id, list_transform(range(64), lambda i: coalesce(m[i] / norm, CAST(0 AS DOUBLE))) AS embedding FROM documents LEFT JOIN v USING (doc_id)""")
def _(t):
    return files.hashing_embedding(_texts(t), "doc_id", "text")


@query("r10_topk_cosine", o("p_chunks", f"WITH {_Q} SELECT chunk_id, round(score, 6) AS score FROM c WHERE label = (SELECT label FROM p_chunks WHERE chunk_id = 0) ORDER BY c.score DESC, chunk_id LIMIT 5"))
def _(t):
    same = t("p_chunks").join(F.broadcast(_asked(t).select("label")), "label", "left_semi")
    return V.top_k(same, _asked(t)).select("chunk_id", F.round("score", 6).alias("score"))


@query("r10_threshold", o("p_chunks", f"WITH {_Q} SELECT chunk_id, round(score, 6) AS score FROM c WHERE score >= 0.2 ORDER BY c.score DESC, chunk_id LIMIT 20"))
def _(t):
    return V.top_k(t("p_chunks"), _asked(t), 20, 0.2).select("chunk_id", F.round("score", 6).alias("score"))


_OPEN = "doc_id IN (SELECT doc_id FROM p_documents WHERE NOT is_deleted AND (access_scope = 'company' OR (access_scope = 'department' AND department_id = 7) OR (access_scope = 'personal' AND uploader_id = 7)))"


@query("r11_permission_filtered_search", o("p_chunks p_documents", f"WITH {_Q} SELECT chunk_id, doc_id, round(score, 6) AS score FROM c WHERE {_OPEN} ORDER BY c.score DESC, chunk_id LIMIT 5"))
def _(t):
    docs = A.accessible_documents(R.base_scan(t("p_documents")), 7, 7)
    return V.permitted_top_k(t("p_chunks"), _asked(t), docs).select("chunk_id", "doc_id", F.round("score", 6).alias("score"))


@query("r12_two_stage", o("p_chunks", f"WITH {_Q}, s AS (SELECT chunk_id FROM c WHERE chunk_id % 10 = 0 ORDER BY score DESC, chunk_id LIMIT 3) SELECT chunk_id, round(score, 6) AS score FROM c WHERE chunk_id % 10 <> 0 AND chunk_id - chunk_id % 10 IN (SELECT chunk_id FROM s) ORDER BY c.score DESC, chunk_id LIMIT 4"))
def _(t):
    c = t("p_chunks")
    parent = F.col("chunk_id") - F.col("chunk_id") % 10
    return V.two_stage(c.where(parent == F.col("chunk_id")), c.where(parent != F.col("chunk_id")).withColumn("parent_id", parent), _asked(t)).select("chunk_id", F.round("score", 6).alias("score"))


@query("r13_bubble_up", o("p_chunks", f"WITH {_Q}, h AS (SELECT * FROM c ORDER BY score DESC, chunk_id LIMIT 6) SELECT doc_id, list(chunk_id ORDER BY score DESC, chunk_id) AS details, round(max(score), 6) AS best FROM h GROUP BY doc_id ORDER BY max(score) DESC, min(chunk_id) LIMIT 3"))
def _(t):
    return V.bubble_up(t("p_chunks"), _asked(t)).select("doc_id", "details", F.round("best", 6).alias("best"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query("r15_full_text", f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'released')")
def _(t):
    return V.match_all(_texts(t), "doc_id", "text", ["the", "released"])


_BM25 = f"""WITH d AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS n, CAST(len(list_filter(w, lambda x: x = 'released')) AS DOUBLE) AS t0, CAST(len(list_filter(w, lambda x: x = 'license')) AS DOUBLE) AS t1 FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
s AS (SELECT count(*) AS docs, avg(n) AS a, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM d),
b AS (SELECT doc_id, ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / a)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / a)) AS score FROM d, s)
"""


@query("r16_bm25", _BM25 + "SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0")
def _(t):
    return V.bm25(_texts(t), "doc_id", "text", ["released", "license"]).select("doc_id", F.round("score", 6).alias("score"))


@query("r16_hybrid_fusion", o("p_chunks", f"""{_BM25.replace('WITH d', f'WITH {_Q}, d')}, v AS (SELECT doc_id, max(round(score, 9)) AS score FROM c GROUP BY doc_id),
    r1 AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM b WHERE score > 0 QUALIFY r <= 100), r2 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM v QUALIFY r <= 100)
    SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY doc_id"""))
def _(t):
    words = V.bm25(_texts(t), "doc_id", "text", ["released", "license"]).select("doc_id", F.round("score", 9).alias("score"))
    vectors = V.scored(t("p_chunks"), _asked(t)).groupBy("doc_id").agg(F.max(F.round("score", 9)).alias("score"))
    return V.fuse([words, vectors], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("r17_rerank", o("p_chunks", f"WITH {_Q}, h AS (SELECT * FROM c ORDER BY score DESC, chunk_id LIMIT 100) SELECT chunk_id FROM h ORDER BY (label = 3) DESC, chunk_id LIMIT 5"))
def _(t):
    return V.rerank(V.top_k(t("p_chunks"), _asked(t), 100), F.col("label") == 3, 5, "chunk_id").select("chunk_id")


@query("r18_answer_context", o("p_chunks", f"WITH {_Q}, h AS (SELECT c.*, left(text, 500) AS text FROM c JOIN documents USING (doc_id) ORDER BY c.score DESC, chunk_id LIMIT 5) SELECT string_agg('- ' || text, chr(10) ORDER BY score DESC, chunk_id) AS context, list(DISTINCT doc_id ORDER BY doc_id) AS sources FROM h"))
def _(t):
    hits = V.top_k(t("p_chunks"), _asked(t)).join(t("documents").select("doc_id", F.left("text", F.lit(500)).alias("text")), "doc_id")
    return V.context(hits)


@query("r21_pipeline_status", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 'failed' ELSE 'completed' END AS status FROM documents")
def _(t):
    done = chunks(t("documents"), "doc_id", "text").select("doc_id").distinct().withColumn("ok", F.lit(True))
    return t("documents").select("doc_id").join(done, "doc_id", "left").select("doc_id", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"))


@query("r23_mark_status", o("p_documents", "SELECT doc_id, CASE WHEN status = 'processing' THEN 'completed' ELSE status END AS status FROM p_documents"))
def _(t):
    return t("p_documents").select("doc_id", F.when(F.col("status") == "processing", "completed").otherwise(F.col("status")).alias("status"))


@query("r26_changed_chunks", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR text <> trim(text)")
def _(t):
    old = t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    new = t("documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.trim("text")).alias("text"))
    return files.changed(old, new, "doc_id", "text")


@query("r27_context_precision", o("p_chunks", f"WITH {_Q}, h AS (SELECT * FROM c ORDER BY score DESC, chunk_id LIMIT 10) SELECT avg(CASE WHEN label = (SELECT label FROM p_chunks WHERE chunk_id = 0) THEN 1.0 ELSE 0.0 END)::DOUBLE AS precision FROM h"))
def _(t):
    hits = V.top_k(t("p_chunks"), _asked(t), 10).crossJoin(F.broadcast(_asked(t).select(F.col("label").alias("want"))))
    return V.precision_at_k(hits, F.col("label") == F.col("want"))


@query("t4_login_windows", o("p_audit_logs", """SELECT account_id, w AS window_start, count(*) AS attempts FROM (SELECT account_id, unnest([time_bucket(INTERVAL 12 HOUR, created_at, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 12 HOUR, created_at, TIMESTAMP '2024-01-01') - INTERVAL 12 HOUR]) AS w FROM p_audit_logs WHERE action = 'LOGIN') GROUP BY 1, 2 HAVING count(*) > 1"""))
def _(t):
    logs = t("p_audit_logs").where("action = 'LOGIN'")
    return audit.frequent(logs, "created_at", "account_id", "24 hours", "12 hours", 1).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("t6_audit_append", o("p_audit_logs", "SELECT event_id, account_id, action, left(props, 255) AS user_agent FROM p_audit_logs WHERE action IN ('LOGIN', 'UPLOAD', 'QUERY', 'DOWNLOAD', 'DELETE')"))
def _(t):
    return audit.entries(t("p_audit_logs"), "props").select("event_id", "account_id", "action", "user_agent")
