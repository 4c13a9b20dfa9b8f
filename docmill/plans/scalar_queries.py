"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import scalars as S
from docmill.plans.proxies import oracle as o
from docmill.plans.registry import query


@query("c1_truncations", "SELECT conv_id, turn, left(text, 50) || '...' AS title, left(text, 500) AS preview FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", S.title("text").alias("title"), F.left("text", F.lit(500)).alias("preview"))


@query("c2_message_preview", "SELECT conv_id, turn, upper(role) || ': ' || left(text, 50) || '...' AS preview FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", S.message_preview("role", "text").alias("preview"))


@query("c3_tags", "SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name || ' ,, x ', ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM part")
def _(t):
    return t("part").select("p_partkey", S.tags(F.replace(F.concat("p_name", F.lit(" ,, x ")), F.lit(" "), F.lit(" , "))).alias("tags"))


@query("c4_tag_normalisation", "SELECT DISTINCT lower(trim(p_brand)) AS tag FROM part")
def _(t):
    return t("part").select(F.lower(F.trim("p_brand")).alias("tag")).distinct()


@query("c5_validators", r"""SELECT c_custkey, regexp_full_match(e, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AND length(e) <= 254 AS email, regexp_full_match(u, '[a-zA-Z0-9_-]{3,30}') AS username,
    regexp_full_match('http://' || u, 'https?://[^\s/$.?#].[^\s]*') AS url, regexp_full_match('0' || right(u, 9), '0[0-9]{9,10}') AS phone, regexp_full_match('84' || right(u, 9), '(0|84)(3|5|7|8|9)([0-9]{8})') AS mobile,
    length(c_name || '!') >= 8 AND regexp_matches(c_name, '[A-Z]') AND regexp_matches(c_name, '[0-9]') AS password
    FROM (SELECT *, lower(trim(c_name)) || '@x' || CASE WHEN c_custkey % 2 = 0 THEN '.org' ELSE '' END AS e, replace(c_name, '#', CASE WHEN c_custkey % 3 = 0 THEN '#' ELSE '_' END) AS u FROM customer)""")
def _(t):
    e = F.concat(F.lower(F.trim("c_name")), F.lit("@x"), F.when(F.col("c_custkey") % 2 == 0, ".org").otherwise(""))
    u = F.replace(F.col("c_name"), F.lit("#"), F.when(F.col("c_custkey") % 3 == 0, "#").otherwise("_"))
    rows = t("customer").withColumns({"e": F.replace(e, F.lit("#"), F.lit("#")), "u": u})
    return rows.select("c_custkey", S.valid("email", "e").alias("email"), S.valid("username", "u").alias("username"), S.valid("url", F.concat(F.lit("http://"), "u")).alias("url"), S.valid("phone", F.concat(F.lit("0"), F.right("u", F.lit(9)))).alias("phone"), S.valid("mobile", F.concat(F.lit("84"), F.right("u", F.lit(9)))).alias("mobile"), S.valid("password", F.concat("c_name", F.lit("!"))).alias("password"))


@query("c7_file_checks", "SELECT doc_id, n_chars <= 2000 AS size_ok, source IN ('src1', 'src2') AS type_ok FROM documents")
def _(t):
    return t("documents").select("doc_id", (F.col("n_chars") <= 2000).alias("size_ok"), F.col("source").isin("src1", "src2").alias("type_ok"))


@query("c8_sanitize", "SELECT doc_id, left(trim(text), 1000) AS clean FROM documents")
def _(t):
    return t("documents").select("doc_id", F.left(F.trim("text"), F.lit(1000)).alias("clean"))


@query("c9_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("c10_extension", "SELECT page_id, regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1) AS extension, regexp_extract(url, '([^/]*?)(\\.[A-Za-z0-9]+)?$', 1) AS stem FROM pages")
def _(t):
    return t("pages").select("page_id", S.extension("url").alias("extension"), S.stem("url").alias("stem"))


_PATHS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' WHEN 2 THEN 'DELETE' ELSE 'HEAD' END AS method,
    CASE doc_id % 3 WHEN 0 THEN '/api/v1/documents/' || doc_id || '/' WHEN 1 THEN '/api/documents/upload/' ELSE '/users/x/roles' END AS path FROM documents"""


@query("c11_audit_inference", f"""SELECT doc_id, CASE WHEN method = 'POST' THEN CASE WHEN contains(lower(path), 'upload') THEN 'UPLOAD' WHEN contains(lower(path), 'create') THEN 'CREATE' WHEN contains(lower(path), 'import') THEN 'IMPORT' ELSE 'CREATE' END
    WHEN method IN ('PUT', 'PATCH') THEN 'UPDATE' WHEN method = 'DELETE' THEN 'DELETE' ELSE 'MUTATION' END AS action,
    CASE WHEN doc_id % 3 = 2 THEN 'users' ELSE 'documents' END AS resource, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS resource_id FROM ({_PATHS})""")
def _(t):
    t("documents").createOrReplaceTempView("documents")
    rows = t.spark.sql(_PATHS)
    return rows.select("doc_id", S.action("method", "path").alias("action"), S.resource("path").alias("resource"), S.resource_id("path").alias("resource_id"))


@query("c12_client_ip", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '10.0.0.2' ELSE '10.0.0.3' END AS ip FROM documents")
def _(t):
    forwarded = F.when(F.col("doc_id") % 3 == 0, " 10.0.0.1 , 9.9.9.9")
    real = F.when(F.col("doc_id") % 3 <= 1, "10.0.0.2")
    return t("documents").select("doc_id", S.client_ip(forwarded, real, F.lit("10.0.0.3")).alias("ip"))


@query("c13_dates", o("p_audit_logs", "SELECT event_id, CAST(created_at AS DATE) AS day, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS text FROM p_audit_logs"))
def _(t):
    return t("p_audit_logs").select("event_id", F.to_date("created_at").alias("day"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("text"))


@query("c14_clamps", "SELECT doc_id, least(100, greatest(0, n_chars - 1000)) AS progress, CAST((n_chars + 99) // 100 AS BIGINT) AS pages FROM documents")
def _(t):
    return t("documents").select("doc_id", F.least(F.lit(100), F.greatest(F.lit(0), F.col("n_chars") - 1000)).alias("progress"), F.ceil(F.col("n_chars") / 100).cast("long").alias("pages"))


@query("c15_json", o("p_audit_logs", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM p_audit_logs"))
def _(t):
    return t("p_audit_logs").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("c16_backoff", o("p_async_tasks", "SELECT task_id, CAST(pow(2, retry_count) AS DOUBLE) AS client_wait, CAST(0.5 * pow(2, retry_count) AS DOUBLE) AS lock_wait, scheduled_at + INTERVAL 5 MINUTE * CAST(pow(2, retry_count + 1) AS INT) AS retry_at FROM p_async_tasks"))
def _(t):
    n = F.col("retry_count")
    wait = F.make_interval(mins=(5 * F.pow(F.lit(2), n + 1)).cast("int"))
    return t("p_async_tasks").select("task_id", F.pow(F.lit(2.0), n).alias("client_wait"), (0.5 * F.pow(F.lit(2.0), n)).alias("lock_wait"), (F.col("scheduled_at") + wait).alias("retry_at"))


@query("c17_citations", o("p_chunks", "SELECT label, list(DISTINCT doc_id ORDER BY doc_id) AS sources, count(*) AS citations FROM p_chunks GROUP BY label"))
def _(t):
    return t("p_chunks").groupBy("label").agg(F.array_sort(F.collect_set("doc_id")).alias("sources"), F.count("*").alias("citations"))


@query("c18_folder_icons", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'project') THEN 'work' WHEN contains(lower(p_type), 'design') THEN 'design_services' WHEN contains(lower(p_type), 'hr') THEN 'group' ELSE 'folder' END AS icon FROM part")
def _(t):
    return t("part").select("p_partkey", S.icon("p_type").alias("icon"))


@query("c19_initials", "SELECT p_partkey, upper(list_aggregate(list_transform(string_split(p_name, ' ')[1:2], lambda x: left(x, 1)), 'string_agg', '')) AS initials FROM part")
def _(t):
    return t("part").select("p_partkey", S.initials("p_name").alias("initials"))


@query("c21_human_size", """SELECT doc_id, CASE WHEN n_chars = 0 THEN '0 B' ELSE CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' ELSE printf('%.2f', round(n_chars / 1024.0, 2)) || ' KB' END END AS size FROM documents""")
def _(t):
    return t("documents").select("doc_id", S.human_size("n_chars").alias("size"))


@query("c22_relative_time", o("p_audit_logs", """SELECT event_id, CASE WHEN s < 3600 THEN 'just now' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || ' hours' WHEN s < 604800 THEN CAST(s // 86400 AS VARCHAR) || ' days'
    WHEN s < 2592000 THEN CAST(s // 604800 AS VARCHAR) || ' weeks' ELSE strftime(created_at, '%Y-%m-%d') END AS age FROM (SELECT *, date_diff('second', created_at, TIMESTAMP '2024-01-31') AS s FROM p_audit_logs)"""))
def _(t):
    return t("p_audit_logs").select("event_id", S.relative_time("created_at", "2024-01-31 00:00:00").alias("age"))


@query("c23_page_strip", o("p_accounts", "SELECT account_id, range(a, least(a + 4, 12) + 1) AS pages FROM (SELECT account_id, greatest(1, least(account_id % 12 + 1 - 2, 8)) AS a FROM p_accounts)"))
def _(t):
    return t("p_accounts").select("account_id", S.page_strip((F.col("account_id") % 12 + 1), 12).alias("pages"))


@query("c24_upload_progress", "SELECT doc_id, CAST(floor((doc_id % 4 + (doc_id % 101) / 100.0) / 4 * 100 + 0.5) AS BIGINT) AS percent, CAST(least(1000 * pow(2, doc_id % 7), 30000) AS DOUBLE) AS delay FROM documents")
def _(t):
    i = F.col("doc_id")
    return t("documents").select("doc_id", F.floor((i % 4 + (i % 101) / F.lit(100.0)) / 4 * 100 + 0.5).cast("long").alias("percent"), F.least(1000 * F.pow(F.lit(2.0), i % 7), F.lit(30000.0)).alias("delay"))
