"""Sources, writes, the upload path and injected model calls."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from docmill.functions import chunking
from docmill.operators import access as A, ingest as I, relational as R
from docmill.operators.lineage import scratch
from docmill.plans.document_queries import _WINDOWS
from docmill.plans.proxies import oracle as o
from docmill.plans.registry import query
from docmill.sources import files, store

#: File names made from the pages' URLs: every supported ending, one in capitals, one unsupported and one without.
_NAMES = "(SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.txt' WHEN 3 THEN '.md' WHEN 4 THEN '.exe' ELSE '/' END AS name, length(html) AS size FROM pages)"
_KIND = "CASE regexp_extract(lower(name), '(\\.[a-z0-9]+)$', 1) WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' END"


def _named(t):
    ends = F.get(F.array(*map(F.lit, (".pdf", ".DOCX", ".txt", ".md", ".exe", "/"))), (F.col("page_id") % 6).cast("int"))
    return t("pages").select("page_id", F.concat("url", ends).alias("name"), F.length("html").alias("size"))


@query("s6_file_dispatch", f"SELECT page_id, {_KIND} AS mime, CASE WHEN {_KIND} IS NULL THEN 'unsupported type' WHEN size > 2000 THEN 'too large' END AS error FROM {_NAMES}")
def _(t):
    name = F.col("name")
    return _named(t).select("page_id", files.kind_of(name).alias("mime"), files.file_error(name, F.col("size"), 2000).alias("error"))


@query("s8_supported_names", f"SELECT page_id, regexp_matches(lower(name), '\\.(pdf|docx|txt|md)$') AS supported FROM {_NAMES}")
def _(t):
    return _named(t).select("page_id", files.kind_of(F.col("name")).isNotNull().alias("supported"))


@query("s10_validation_of_types", f"SELECT page_id, size <= 2000 AND {_KIND} IS NOT NULL AS ok FROM {_NAMES}")
def _(t):
    rows = _named(t).withColumn("mime", files.kind_of(F.col("name")))
    return files.validate(rows, "size", "mime", 2000).select("page_id", "ok")


@query("s11_download", o("p_documents", """SELECT doc_id, md5(text) AS content_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM p_documents WHERE NOT is_deleted
    AND (access_scope = 'company' OR (access_scope = 'department' AND department_id = 7) OR (access_scope = 'personal' AND uploader_id = 7)))"""))
def _(t):
    allowed = A.accessible_documents(R.base_scan(t("p_documents")), 7, 7)
    return store.download(t("documents").select("doc_id", "text"), allowed).select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_md5"))


@query("s12_batched_append", o("p_accounts", "SELECT count(*) AS rows, CAST(sum(account_id) AS BIGINT) AS ids, true AS small_files FROM p_accounts"))
def _(t):
    path = scratch(t.spark, "append")
    store.append(t("p_accounts"), path)
    written = t.spark.read.parquet(path)
    by_file = written.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum("account_id").alias("ids"))
    return by_file.agg(F.sum("n").alias("rows"), F.sum("ids").alias("ids"), (F.max("n") <= 1000).alias("small_files"))


@query("s13_keyed_overwrite", o("p_async_tasks", """SELECT task_id, CASE WHEN status = 'pending' THEN 'running' ELSE status END AS status, priority FROM p_async_tasks
    UNION ALL SELECT task_id + 100000000, 'pending', NULL FROM p_async_tasks WHERE retry_count = 3"""))
def _(t):
    path = scratch(t.spark, "tasks")
    tasks = t("p_async_tasks")
    store.append(tasks.select("task_id", "status", "priority"), path, 1_000_000)
    changes = tasks.where("status = 'pending'").select("task_id", F.lit("running").alias("status"))
    changes = changes.unionByName(tasks.where("retry_count = 3").select((F.col("task_id") + 100_000_000).alias("task_id"), F.lit("pending").alias("status")))
    return store.overwrite_keyed(t.spark, path, changes, "task_id", scratch(t.spark, "tasks"))


def _points(t):
    payload = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("state"), F.lit("old"))
    return t("p_chunks").select(F.col("chunk_id").alias("point_id"), F.col("embedding").cast("array<float>").alias("embedding"), payload.alias("payload"))


@query("s15_vector_upsert", o("p_chunks", """SELECT chunk_id AS point_id, CAST(label AS VARCHAR) AS label, CASE WHEN chunk_id % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN chunk_id % 3 = 0 THEN 'x' END AS tag,
    CASE WHEN chunk_id % 6 = 0 THEN 1.0 ELSE CAST(embedding[1] AS DOUBLE) END AS first FROM p_chunks UNION ALL SELECT chunk_id + 1000000, NULL, 'new', 'x', 1.0 FROM p_chunks WHERE chunk_id % 6 = 0"""))
def _(t):
    ones = F.array_repeat(F.lit(1.0).cast("float"), 64)
    payload = F.create_map(F.lit("state"), F.lit("new"), F.lit("tag"), F.lit("x"))
    base = t("p_chunks").where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("point_id"), F.when(F.col("chunk_id") % 6 == 0, ones).alias("embedding"), payload.alias("payload"))
    fresh = base.where("point_id % 6 = 0").withColumn("point_id", F.col("point_id") + 1_000_000)
    got = store.upsert_points(_points(t), base.unionByName(fresh), 64)
    value = lambda k: F.try_element_at("payload", F.lit(k)).alias(k)
    return got.select("point_id", value("label"), value("state"), value("tag"), F.get("embedding", 0).cast("double").alias("first"))


@query("s16_vector_delete_by_filter", o("p_chunks", "SELECT chunk_id AS point_id FROM p_chunks WHERE label <> 3 AND chunk_id NOT IN (SELECT doc_id FROM documents)"))
def _(t):
    ids = t("documents").select(F.col("doc_id").alias("point_id"))
    return store.delete_points(_points(t), F.try_element_at("payload", F.lit("label")) == "3", ids).select("point_id")


@query("s20_seed_roles", o("p_roles", "SELECT code FROM p_roles UNION SELECT unnest(['admin', 'manager', 'user', 'guest'])"))
def _(t):
    seeds = t.spark.createDataFrame([("admin",), ("manager",), ("user",), ("guest",)], "code string")
    return t("p_roles").select("code").unionByName(R.missing_links(t("p_roles"), seeds, ["code"]))


@query("s21_monthly_archive", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderdate < DATE '1995-03-01' GROUP BY 1")
def _(t):
    path = scratch(t.spark, "months")
    store.write_by_month(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", path)
    kept = store.archive(t.spark, path, "1995-03", scratch(t.spark, "archive"))
    return kept.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("j16_acl_subjects", o("p_document_permissions p_accounts p_roles", """SELECT doc_id, subject_type, subject_id, CASE subject_type WHEN 'account' THEN username WHEN 'role' THEN code END AS subject_name, precedence
    FROM p_document_permissions LEFT JOIN p_accounts ON subject_type = 'account' AND account_id = subject_id LEFT JOIN p_roles ON subject_type = 'role' AND role_id = subject_id"""))
def _(t):
    return A.named_subjects(t("p_document_permissions"), t("p_accounts"), t("p_roles")).select("doc_id", "subject_type", "subject_id", "subject_name", "precedence")


@query("r1_word_offsets", None)
def _(t):
    return chunking.words(t("documents"), "doc_id", "text")


@query("r1_word_offset_sums", r"""SELECT doc_id, count(*) AS words, CAST(sum(length(w)) AS BIGINT) AS word_chars, CAST(max(length(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS BIGINT) AS last_end
    FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents) GROUP BY doc_id""")
def _(t):
    spans = chunking.words(t("documents"), "doc_id", "text")
    return spans.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(F.col("end_char") - F.col("start_char")).alias("word_chars"), F.max("end_char").alias("last_end"))


@query("r2_words_before", r"""SELECT doc_id, position, CAST(len(regexp_extract_all(left(text, position), '\S+')) - CASE WHEN position > 0 AND regexp_matches(left(text, position), '\S$') AND regexp_matches(substr(text, position + 1, 1), '\S') THEN 1 ELSE 0 END AS BIGINT) AS word
    FROM (SELECT doc_id, text, unnest([length(text) * 0 // 4, length(text) * 1 // 4, length(text) * 2 // 4, length(text) * 3 // 4, length(text) * 4 // 4]) AS position FROM documents)""")
def _(t):
    return chunking.words_before(t("documents"), "doc_id", "text", lambda x: [len(x) * k // 4 for k in range(5)])


@query("r3_structural_breaks", r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents WHERE NOT regexp_matches(text, '\n\s*\n'))
    SELECT doc_id, CAST(unnest(list_distinct(CASE WHEN len(ws) > 240 THEN list_append(list_filter(range(1, len(ws)), lambda i: regexp_matches(ws[i], '[.!?]$')), len(ws)) WHEN len(ws) > 0 THEN [len(ws)] ELSE [] END)) AS BIGINT) AS at FROM s""")
def _(t):
    one_paragraph = t("documents").where(~F.col("text").rlike(r"\n\s*\n"))
    return chunking.structural_breaks(one_paragraph, "doc_id", "text")


@query("r6_character_windows", "SELECT doc_id, s AS start_char, least(length(text), s + 1000) AS end_char FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) - 200), 800)) AS s FROM documents WHERE length(text) > 0)")
def _(t):
    return chunking.character_windows(t("documents"), "doc_id", "text")


_DOTTED = r"'^(\d+(?:\.\d+)*)\.?\s+(\S.{0,80})$'"


@query("r14_headings", rf"""WITH l AS (SELECT conv_id, turn, unnest(string_split(content, chr(10))) AS raw, unnest(range(len(string_split(content, chr(10))))) AS line FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '## ' || text WHEN 1 THEN '2.1 ' || left(text, 60) ELSE upper(left(text, 70)) END AS content FROM conversations)),
    s AS (SELECT *, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') AS t FROM l)
    SELECT conv_id * 1000 + turn AS message, CAST(line AS BIGINT) AS line, CAST(CASE WHEN regexp_matches(t, '^#{{1,6}}\s+.+') THEN length(regexp_extract(t, '^(#{{1,6}})', 1)) WHEN regexp_matches(t, {_DOTTED}) THEN len(string_split(regexp_extract(t, {_DOTTED}, 1), '.')) ELSE 1 END AS BIGINT) AS level
    FROM s WHERE regexp_matches(t, '^#{{1,6}}\s+.+') OR regexp_matches(t, {_DOTTED}) OR (t <> '' AND length(t) <= 80 AND upper(t) = t AND regexp_matches(t, '\p{{L}}') AND NOT regexp_matches(t, '[.!?]$'))""")
def _(t):
    kind = F.col("turn") % 3
    text = F.when(kind == 0, F.concat(F.lit("## "), "text")).when(kind == 1, F.concat(F.lit("2.1 "), F.left("text", F.lit(60)))).otherwise(F.upper(F.left("text", F.lit(70))))
    messages = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), text.alias("text"))
    return chunking.heading_rows(messages, "message", "text").select("message", "line", "level")


@query("r14_recursive_pieces", None)
def _(t):
    return chunking.pieces(t("documents"), "doc_id", "text")


def _embedder(texts: list) -> list:
    """Stands in for an embedding service: it refuses a chunk that speaks of a license."""
    return [None if "license" in x else [float(len(x.split())), 1.0] for x in texts]


_STORED = _WINDOWS + ", ok AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S') AND NOT contains(text, 'license'))"


@query("r8_chunk_embed_store", _STORED + "SELECT doc_id, CAST(seq AS BIGINT) AS sequence, CAST(e - s AS DOUBLE) AS words FROM t WHERE doc_id IN (SELECT doc_id FROM ok)")
def _(t):
    points, _ = I.ingest(t("documents"), "doc_id", "text", _embedder, 2)
    return points.select("doc_id", F.col("sequence").cast("long").alias("sequence"), F.get("embedding", 0).alias("words"))


@query("r21_upload_transitions", """SELECT doc_id, unnest([1, 2]) AS step, unnest(['pending', 'processing']) AS from_status, unnest(['processing', CASE WHEN regexp_matches(text, '\\S') AND NOT contains(text, 'license') THEN 'completed' ELSE 'failed' END]) AS to_status FROM documents""")
def _(t):
    _, status = I.ingest(t("documents"), "doc_id", "text", _embedder, 2)
    return I.transitions(status, "doc_id")


@query("r22_personal_uploads", o("p_documents p_accounts", "SELECT doc_id, a.department_id, 'personal' AS access_scope, 'pending' AS status FROM p_documents d LEFT JOIN p_accounts a ON a.account_id = d.uploader_id"))
def _(t):
    uploads = t("p_documents").select("doc_id", "uploader_id")
    return I.personal_uploads(uploads, t("p_accounts")).select("doc_id", "department_id", "access_scope", "status")


@query("r19_completions", "SELECT conv_id, turn, 'echo: ' || right(text, 20) AS answer FROM conversations WHERE role = 'user'")
def _(t):
    asked = t("conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return I.called(asked, "text", lambda prompts: [f"echo: {p[-20:]}" for p in prompts]).select("conv_id", "turn", F.col("result").alias("answer"))


class _Flaky:
    """A service that is down at every batch's first two calls, and refuses some values for good."""

    def __init__(self):
        self.calls = 0

    def __call__(self, values: list) -> list:
        self.calls += 1
        if self.calls % 3:
            raise I.ServiceError(503, "down") if self.calls % 3 == 1 else ConnectionError("lost")
        if any(v % 50 == 0 for v in values):
            raise I.ServiceError(400, "refused")
        return [v * 2 for v in values]


@query("r20_retries", "SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN doc_id * 2 END AS doubled, CASE WHEN doc_id % 50 = 0 THEN '400 refused' END AS error FROM documents")
def _(t):
    return I.called(t("documents").select("doc_id"), "doc_id", _Flaky(), T.LongType(), batch=32, wait=0.0).select("doc_id", F.col("result").alias("doubled"), "error")


@query("u6_role_permission_changes", o("p_role_permissions", """SELECT code, 'add' AS change FROM p_role_permissions WHERE role_id = 1 AND code NOT IN (SELECT code FROM p_role_permissions WHERE role_id = 0)
    UNION ALL SELECT code, 'remove' FROM p_role_permissions WHERE role_id = 0 AND code NOT IN (SELECT code FROM p_role_permissions WHERE role_id = 1)"""))
def _(t):
    of = lambda role: t("p_role_permissions").where(F.col("role_id") == role).select("code")
    return R.replace_set(of(0), of(1), ["code"])


@query("c20_tokens", "SELECT account_id, true AS ok, true AS distinct_tokens FROM (SELECT c_custkey AS account_id FROM customer)")
def _(t):
    from pyspark.sql import Window

    tokens = t("p_accounts").select("account_id", F.uuid().alias("token"))
    return tokens.select("account_id", F.col("token").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("ok"), (F.count("*").over(Window.partitionBy("token")) == 1).alias("distinct_tokens"))
