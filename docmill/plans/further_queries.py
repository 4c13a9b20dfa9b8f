"""Further listings, joins, guards and pipeline steps."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from docmill.functions import chunking, scalars as S
from docmill.operators import access as A, guards, hierarchy as H, relational as R, retrieval as V
from docmill.plans.proxies import oracle as o
from docmill.plans.registry import query


@query("s12_append", o("p_accounts", "SELECT account_id, username FROM p_accounts UNION ALL SELECT account_id + 1000000, username || '-copy' FROM p_accounts WHERE status = 'active'"))
def _(t):
    new = t("p_accounts").where("status = 'active'").select((F.col("account_id") + 1_000_000).alias("account_id"), F.concat("username", F.lit("-copy")).alias("username"))
    return t("p_accounts").select("account_id", "username").unionByName(new)


@query("f29_folder_filter_keeps_ancestors", o("p_folders", """WITH up(folder_id, anc) AS (SELECT folder_id, folder_id FROM p_folders UNION ALL SELECT u.folder_id, f.parent_id FROM up u JOIN p_folders f ON f.folder_id = u.anc WHERE f.parent_id IS NOT NULL)
    SELECT DISTINCT anc AS folder_id FROM up WHERE folder_id IN (SELECT folder_id FROM p_folders WHERE contains(upper(name), 'RED G'))""", recursive=True))
def _(t):
    hits = t("p_folders").where(R.contains(["name"], "red g")).select("folder_id")
    return R.semi(H.ancestors(t("p_folders")), hits, "folder_id").select(F.col("ancestor").alias("folder_id")).distinct()


@query("f30_last_errors", o("p_audit_logs", "SELECT event_id FROM p_audit_logs WHERE is_failed ORDER BY created_at DESC, event_id DESC LIMIT 100"))
def _(t):
    return t("p_audit_logs").where("is_failed").orderBy(R.desc("created_at"), F.desc("event_id")).limit(100).select("event_id")


@query("j11_roles_of_users", o("p_account_roles p_roles p_role_permissions", """SELECT account_id, r.code AS role, list(p.code ORDER BY p.code) AS permissions FROM p_account_roles JOIN p_roles r USING (role_id) JOIN p_role_permissions p USING (role_id) GROUP BY 1, 2"""))
def _(t):
    lists = R.nested(t("p_role_permissions"), ["role_id"], F.col("code"), "permissions")
    return t("p_account_roles").join(t("p_roles").join(lists, "role_id"), "role_id").select("account_id", F.col("code").alias("role"), "permissions")


@query("j15_attached_folder_documents", o("p_messages p_folders p_documents", """SELECT DISTINCT conversation_id, doc_id FROM (SELECT DISTINCT conversation_id FROM p_messages) JOIN p_folders f ON f.folder_id = conversation_id + 1 JOIN p_documents USING (folder_id) WHERE NOT is_deleted"""))
def _(t):
    attached = t("p_messages").select("conversation_id", (F.col("conversation_id") + 1).alias("folder_id")).distinct()
    docs = R.base_scan(t("p_documents")).select("folder_id", "doc_id")
    return attached.join(t("p_folders").select("folder_id"), "folder_id").join(docs, "folder_id").select("conversation_id", "doc_id").distinct()


@query("j17_hits_with_parents", o("p_chunks p_documents", """SELECT c.chunk_id, d.original_name, d.folder_id FROM (SELECT * FROM p_chunks ORDER BY label DESC, chunk_id LIMIT 50) c JOIN p_documents d USING (doc_id)"""))
def _(t):
    hits = t("p_chunks").orderBy(F.desc("label"), "chunk_id").limit(50)  # a top-k report
    return hits.join(t("p_documents").select("doc_id", "original_name", "folder_id"), "doc_id").select("chunk_id", "original_name", "folder_id")


@query("j22_conversation_permissions", o("p_messages p_documents", """SELECT conversation_id, doc_id FROM (SELECT DISTINCT conversation_id, conversation_id * 3 AS doc_id FROM p_messages) WHERE doc_id IN (SELECT doc_id FROM p_documents WHERE access_scope = 'company' AND NOT is_deleted)"""))
def _(t):
    attached = t("p_messages").select("conversation_id", (F.col("conversation_id") * 3).alias("doc_id")).distinct()
    return R.semi(attached, R.base_scan(t("p_documents")).where("access_scope = 'company'"), "doc_id").select("conversation_id", "doc_id")


@query("l4_document_page", o("p_documents", "SELECT doc_id FROM p_documents WHERE NOT is_deleted AND access_scope = 'company' ORDER BY file_size DESC, doc_id LIMIT 20 OFFSET 20"))
def _(t):
    return R.page(R.base_scan(t("p_documents")).where("access_scope = 'company'"), [R.desc("file_size"), R.asc("doc_id")], 2, 20, clamp=False).select("doc_id")


@query("l5_search_page", o("p_documents", "SELECT doc_id FROM p_documents WHERE contains(upper(original_name), 'SRC1') AND (access_scope = 'company' OR (access_scope = 'department' AND department_id = 7) OR (access_scope = 'personal' AND uploader_id = 7)) ORDER BY doc_id LIMIT 10"))
def _(t):
    found = A.accessible_documents(t("p_documents").where(R.contains(["original_name"], "src1")), 7, 7)
    return R.page(found, [R.asc("doc_id")], 1, 10, clamp=False).select("doc_id")


@query("l6_department_folders_page", o("p_folders", "SELECT folder_id FROM p_folders WHERE department_id = 0 AND parent_id IS NULL ORDER BY name, folder_id LIMIT 50"))
def _(t):
    return R.page(t("p_folders").where("department_id = 0 AND parent_id IS NULL"), [R.asc("name"), R.asc("folder_id")], 1, 50).select("folder_id")


@query("l7_page_envelope", o("p_documents", """SELECT n.number, count(*) AS total, CAST(ceil(count(*) / 15.0) AS BIGINT) AS pages, n.number < ceil(count(*) / 15.0) AS has_next, n.number > 1 AS has_previous
    FROM p_documents, (VALUES (CAST(1 AS BIGINT)), (CAST(3 AS BIGINT)), (CAST(100000 AS BIGINT))) AS n(number) GROUP BY n.number"""))
def _(t):
    return R.page_envelope(t("p_documents"), [1, 3, 100_000], 15)


@query("l11_conversations_by_activity", o("p_messages", "SELECT conversation_id, CAST(max(turn) AS BIGINT) AS last_turn FROM p_messages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def _(t):
    return t("p_messages").groupBy("conversation_id").agg(F.max("turn").cast("long").alias("last_turn")).orderBy(R.desc("last_turn"), "conversation_id").limit(20)


@query("l14_display_slices", o("p_folders", "SELECT parent_id, list(folder_id ORDER BY folder_id)[1:3] AS shown FROM p_folders WHERE parent_id IS NOT NULL GROUP BY parent_id"))
def _(t):
    return H.children_lists(t("p_folders"), "folder_id").select("parent_id", F.slice("children", 1, 3).alias("shown"))


@query("w1_share_of_total", o("p_audit_logs", "SELECT action, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM p_audit_logs GROUP BY action"))
def _(t):
    counts = t("p_audit_logs").groupBy("action").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row for each action


@query("g20_conversation_summary", o("p_messages", "SELECT conversation_id, count(*) AS messages, list(DISTINCT role ORDER BY role) AS roles, CAST(sum(length(content)) AS BIGINT) AS chars FROM p_messages GROUP BY 1"))
def _(t):
    return t("p_messages").groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sort_array(F.collect_set("role")).alias("roles"), F.sum(F.length("content")).alias("chars"))


@query("g23_serializer_counts", o("p_departments p_accounts p_folders", """SELECT d.dept_id, count(DISTINCT a.account_id) AS members, count(DISTINCT f.folder_id) AS folders FROM p_departments d
    LEFT JOIN p_accounts a ON a.department_id = d.dept_id AND NOT a.is_deleted LEFT JOIN p_folders f ON f.department_id = d.dept_id GROUP BY 1"""))
def _(t):
    out = t("p_departments").select("dept_id")
    for name, rows in (("members", R.base_scan(t("p_accounts"))), ("folders", t("p_folders"))):
        out = out.join(rows.groupBy(F.col("department_id").alias("dept_id")).agg(F.count("*").alias(name)), "dept_id", "left")
    return out.na.fill(0)


@query("a10_folder_access", o("p_folders p_departments", """WITH up(dept_id, anc) AS (SELECT dept_id, dept_id FROM p_departments UNION ALL SELECT u.dept_id, d.parent_id FROM up u JOIN p_departments d ON d.dept_id = u.anc WHERE d.parent_id IS NOT NULL)
    SELECT folder_id FROM p_folders WHERE department_id IN (SELECT dept_id FROM up WHERE anc = 1001) AND access_scope <> 'personal'""", recursive=True))
def _(t):
    below = H.ancestors(t("p_departments"), "dept_id").where("ancestor = 1001").select(F.col("dept_id").alias("department_id"))
    return R.semi(t("p_folders").where("access_scope <> 'personal'"), below, "department_id").select("folder_id")


@query("a11_explicit_and_folder_documents", o("p_documents p_document_permissions p_folder_permissions", """SELECT doc_id FROM p_document_permissions WHERE subject_type = 'role' AND subject_id = 2 AND precedence <> 'deny'
    UNION SELECT doc_id FROM p_documents WHERE folder_id IN (SELECT folder_id FROM p_folder_permissions WHERE subject_id = 2)"""))
def _(t):
    direct = t("p_document_permissions").where("subject_type = 'role' AND subject_id = 2 AND precedence <> 'deny'").select("doc_id")
    return direct.union(R.semi(t("p_documents"), t("p_folder_permissions").where("subject_id = 2"), "folder_id").select("doc_id")).distinct()


@query("a16_guards", o("p_accounts p_account_roles p_roles p_role_permissions", """SELECT a.account_id, bool_or(coalesce(r.code IN ('admin', 'manager'), false)) AS manager, bool_or(coalesce(p.code = 'document_update', false)) AS may_update FROM p_accounts a
    LEFT JOIN p_account_roles USING (account_id) LEFT JOIN p_roles r USING (role_id) LEFT JOIN p_role_permissions p USING (role_id) GROUP BY 1"""))
def _(t):
    return guards.account_flags(t("p_accounts"), t("p_account_roles"), t("p_roles"), t("p_role_permissions"), "document_update")


@query("r2_char_to_word", r"SELECT doc_id, CAST(len(regexp_extract_all(substr(text, 1, CASE WHEN substr(text, 101, 1) IN ('', ' ', chr(10)) THEN 100 ELSE 100 - length(regexp_extract(left(text, 100), '\S*$')) END), '\S+')) AS BIGINT) AS words_before FROM documents")
def _(t):
    return chunking.words_before(t("documents"), "doc_id", "text", lambda _: [100]).select("doc_id", F.col("word").alias("words_before"))


@query("r5_chunk_profiles", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 260 ELSE 240 END AS size, CASE doc_id % 3 WHEN 0 THEN 40 WHEN 1 THEN 52 ELSE 48 END AS overlap FROM documents")
def _(t):
    kinds = F.get(F.array(F.lit("application/pdf"), F.lit("text/plain"), F.lit("other")), (F.col("doc_id") % 3).cast("int"))
    table = [(k, *chunking.profile(k)[1:]) for k in ("application/pdf", "text/plain", "other")]
    profiles = t.spark.createDataFrame(table, "kind string, size int, overlap int")
    return t("documents").select("doc_id", kinds.alias("kind")).join(F.broadcast(profiles), "kind").select("doc_id", "size", "overlap")


@query("r6_char_windows", "SELECT doc_id, unnest(range(0, greatest(1, length(text) - 200), 800)) AS start_char, length(text) AS n FROM documents WHERE length(text) > 0")
def _(t):
    n = F.length("text").cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), n - 200) - 1, F.lit(800).cast("long"))
    return t("documents").where(n > 0).select("doc_id", F.explode(starts).alias("start_char"), n.alias("n"))


@query("r24_reprocess", o("p_documents", "SELECT doc_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM p_documents"))
def _(t):
    return t("p_documents").select("doc_id", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")).alias("status"))


_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM p_chunks WHERE chunk_id = 0), c AS (SELECT chunk_id, doc_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS score FROM p_chunks)"


@query("r28_headed_context", o("p_chunks p_documents", f"""WITH {_Q}, h AS (SELECT c.*, original_name FROM c JOIN p_documents USING (doc_id) WHERE access_scope = 'company' ORDER BY score DESC, chunk_id LIMIT 20)
    SELECT original_name AS source, string_agg(CASE WHEN chunk_id % 10 = 0 THEN '[SUMMARY] ' ELSE '[DETAIL] ' END || chunk_id, chr(10) ORDER BY score DESC, chunk_id) AS context FROM h GROUP BY 1"""))
def _(t):
    docs = t("p_documents").where("access_scope = 'company'")
    hits = V.permitted_top_k(t("p_chunks"), t("p_chunks").where("chunk_id = 0"), docs, 20).join(docs.select("doc_id", F.col("original_name").alias("source")), "doc_id")
    line = F.concat(F.when(F.col("chunk_id") % 10 == 0, "[SUMMARY] ").otherwise("[DETAIL] "), F.col("chunk_id").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", line.alias("line"))))
    return hits.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("context"))


@query("c6_validator_dispatch", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN regexp_full_match(v, '[a-zA-Z0-9_-]{3,30}') WHEN 1 THEN regexp_full_match(v, '0[0-9]{9,10}') WHEN 2 THEN regexp_full_match(lower(v), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}') END AS ok
    FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', CASE WHEN c_custkey % 8 = 0 THEN '_' ELSE '#' END) WHEN 1 THEN '0' || (c_custkey + 10000000) * 10 ELSE c_custkey || '@example.com' END AS v FROM customer)""")
def _(t):
    key = F.col("c_custkey")
    kind = F.get(F.array(*map(F.lit, ("username", "phone", "email", "other"))), (key % 4).cast("int"))
    name = F.when(key % 8 == 0, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.col("c_name"))
    value = F.when(key % 4 == 0, name).when(key % 4 == 1, F.concat(F.lit("0"), ((key + 10_000_000) * 10).cast("string"))).otherwise(F.concat(key.cast("string"), F.lit("@example.com")))
    rows = t("customer").select("c_custkey", kind.alias("kind"), value.alias("value"))
    return rows.select("c_custkey", S.valid_by("kind", "value").alias("ok"))


@query("t2_task_counts", o("p_async_tasks", "SELECT status, priority, count(*) AS n FROM p_async_tasks GROUP BY 1, 2"))
def _(t):
    return t("p_async_tasks").groupBy("status", "priority").agg(F.count("*").alias("n"))
