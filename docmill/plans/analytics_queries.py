"""Aggregations, windows, queue and audit analytics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from docmill.operators import hierarchy as H, relational as R
from docmill.plans.proxies import oracle as o
from docmill.plans.registry import query
from docmill.streaming import queue


@query("g1_count", o("p_documents", "SELECT count(*) AS n FROM p_documents WHERE status = 'failed'"))
def _(t):
    return t("p_documents").where("status = 'failed'").agg(F.count("*").alias("n"))


@query("g2_document_statistics", o("p_documents", """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
    count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size,
    CAST(coalesce(sum(file_size), 0) // 1024 AS BIGINT) AS size_kb FROM p_documents WHERE NOT is_deleted"""))
def _(t):
    size = F.coalesce(F.sum("file_size"), F.lit(0))
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")]
    return R.base_scan(t("p_documents")).agg(F.count("*").alias("total"), *by, size.alias("total_size"), F.floor(size / 1024).cast("long").alias("size_kb"))


@query("g3_chunks_per_document", o("p_chunks", "SELECT doc_id, count(*) AS chunks FROM p_chunks GROUP BY doc_id"))
def _(t):
    return t("p_chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("g4_processing_progress", o("p_chunks", """SELECT doc_id, count(*) AS total, count(DISTINCT CASE WHEN label < 7 THEN chunk_id END) AS embedded,
    greatest(0, count(*) - count(DISTINCT CASE WHEN label < 7 THEN chunk_id END)) AS pending FROM p_chunks GROUP BY doc_id"""))
def _(t):
    done = t("p_chunks").where("label < 7").select("chunk_id", F.lit(1).alias("e")).distinct()
    rows = t("p_chunks").select("doc_id", "chunk_id").join(done, "chunk_id", "left")
    return rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("e").alias("embedded")).withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("embedded")))


@query("g5_department_counts", o("p_departments p_accounts p_folders p_documents", """SELECT d.dept_id,
    (SELECT count(*) FROM p_accounts a WHERE a.department_id = d.dept_id AND NOT a.is_deleted) AS members,
    (SELECT count(*) FROM p_folders f WHERE f.department_id = d.dept_id) AS folders,
    (SELECT count(DISTINCT x.doc_id) FROM (SELECT doc_id, department_id AS k FROM p_documents WHERE NOT is_deleted UNION ALL SELECT doc_id, f.department_id FROM p_documents JOIN p_folders f USING (folder_id) WHERE NOT is_deleted) x WHERE x.k = d.dept_id) AS documents,
    (SELECT count(*) FROM p_departments c WHERE c.parent_id = d.dept_id) AS sub_departments FROM p_departments d"""))
def _(t):
    docs = R.base_scan(t("p_documents"))
    either = docs.select("doc_id", F.col("department_id").alias("dept_id")).unionByName(docs.select("doc_id", "folder_id").join(t("p_folders").select("folder_id", F.col("department_id").alias("dept_id")), "folder_id").select("doc_id", "dept_id")).distinct()
    counts = {
        "members": R.base_scan(t("p_accounts")).select(F.col("department_id").alias("dept_id")),
        "folders": t("p_folders").select(F.col("department_id").alias("dept_id")),
        "documents": either,
        "sub_departments": t("p_departments").select(F.col("parent_id").alias("dept_id")),
    }
    out = t("p_departments").select("dept_id")
    for name, rows in counts.items():
        out = out.join(rows.groupBy("dept_id").agg(F.count("*").alias(name)), "dept_id", "left")
    return out.na.fill(0, list(counts))


@query("g6_folder_child_counts", o("p_folders p_documents", """SELECT f.folder_id, coalesce(d.n, 0) AS documents, coalesce(c.n, 0) AS subfolders FROM p_folders f
    LEFT JOIN (SELECT folder_id, count(*) AS n FROM p_documents WHERE NOT is_deleted GROUP BY 1) d USING (folder_id) LEFT JOIN (SELECT parent_id, count(*) AS n FROM p_folders GROUP BY 1) c ON c.parent_id = f.folder_id"""))
def _(t):
    docs = R.base_scan(t("p_documents")).groupBy("folder_id").agg(F.count("*").alias("documents"))
    subs = t("p_folders").where("parent_id is not null").groupBy(F.col("parent_id").alias("folder_id")).agg(F.count("*").alias("subfolders"))
    return t("p_folders").select("folder_id").join(docs, "folder_id", "left").join(subs, "folder_id", "left").na.fill(0)


@query("g7_role_counts", o("p_roles p_role_permissions p_account_roles", """SELECT role_id, (SELECT count(*) FROM p_role_permissions p WHERE p.role_id = r.role_id) AS permission_count,
    (SELECT count(*) FROM p_account_roles a WHERE a.role_id = r.role_id) AS user_count FROM p_roles r"""))
def _(t):
    out = t("p_roles").select("role_id")
    for name, rows in (("permission_count", t("p_role_permissions")), ("user_count", t("p_account_roles"))):
        out = out.join(rows.groupBy("role_id").agg(F.count("*").alias(name)), "role_id", "left")
    return out.na.fill(0)


@query("g8_profiles_per_department", o("p_accounts", "SELECT department_id, count(*) AS profiles FROM p_accounts WHERE NOT is_deleted GROUP BY department_id"))
def _(t):
    return R.base_scan(t("p_accounts")).groupBy("department_id").agg(F.count("*").alias("profiles"))


@query("g9_message_counts", o("p_messages", "SELECT conversation_id, count(*) AS messages FROM p_messages GROUP BY 1"))
def _(t):
    return t("p_messages").groupBy("conversation_id").agg(F.count("*").alias("messages"))


@query("g10_feedback_share", o("p_human_feedback", "SELECT rating, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM p_human_feedback GROUP BY rating"))
def _(t):
    counts = t("p_human_feedback").groupBy("rating").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # two ratings


@query("g11_daily_trend", o("p_audit_logs", "SELECT CAST(created_at AS DATE) AS day, action, count(*) AS n FROM p_audit_logs GROUP BY 1, 2"))
def _(t):
    return t("p_audit_logs").groupBy(F.to_date("created_at").alias("day"), "action").agg(F.count("*").alias("n"))


@query("g12_suspicious_logins", o("p_audit_logs", "SELECT account_id, count(*) AS attempts FROM p_audit_logs WHERE action = 'LOGIN' AND created_at > TIMESTAMP '2024-01-30' - INTERVAL 240 HOUR GROUP BY account_id HAVING count(*) > 5"))
def _(t):
    recent = t("p_audit_logs").where("action = 'LOGIN' AND created_at > TIMESTAMP_NTZ'2024-01-30' - INTERVAL 240 HOUR")
    return recent.groupBy("account_id").agg(F.count("*").alias("attempts")).where("attempts > 5")


@query("g13_cache_statistics", o("p_async_tasks", """SELECT count(DISTINCT task_id) AS tasks, count(DISTINCT status) AS statuses, count(*) FILTER (WHERE scheduled_at <= TIMESTAMP '1996-01-01') AS expired,
    round(100.0 * count(*) FILTER (WHERE scheduled_at <= TIMESTAMP '1996-01-01') / nullif(count(*), 0), 2) AS expiry_rate FROM p_async_tasks"""))
def _(t):
    late = F.count_if(F.col("scheduled_at") <= F.expr("TIMESTAMP_NTZ'1996-01-01'"))
    return t("p_async_tasks").agg(F.countDistinct("task_id").alias("tasks"), F.countDistinct("status").alias("statuses"), late.alias("expired"), F.round(100.0 * late / F.nullif(F.count("*"), F.lit(0)), 2).alias("expiry_rate"))


@query("g14_deleted_monitor", o("p_documents p_accounts", """SELECT 'documents' AS entity, count(*) AS total, count(*) FILTER (WHERE is_deleted) AS deleted FROM p_documents
    UNION ALL SELECT 'accounts', count(*), count(*) FILTER (WHERE is_deleted) FROM p_accounts"""))
def _(t):
    of = lambda name: t(f"p_{name}").agg(F.count("*").alias("total"), F.count_if("is_deleted").alias("deleted")).select(F.lit(name).alias("entity"), "total", "deleted")
    return of("documents").unionByName(of("accounts"))


@query("g15_admin_statistics", o("p_accounts p_documents p_audit_logs", """SELECT (SELECT count(*) FROM p_accounts WHERE NOT is_deleted) AS users, (SELECT count(*) FROM p_documents WHERE NOT is_deleted) AS documents,
    (SELECT count(*) FROM p_audit_logs WHERE action = 'QUERY' AND CAST(created_at AS DATE) = DATE '2024-01-10') AS queries_today, (SELECT CAST(sum(file_size) AS BIGINT) FROM p_documents WHERE NOT is_deleted) AS storage"""))
def _(t):
    users = R.base_scan(t("p_accounts")).agg(F.count("*").alias("users"))
    docs = R.base_scan(t("p_documents")).agg(F.count("*").alias("documents"), F.sum("file_size").alias("storage"))
    asked = t("p_audit_logs").where("action = 'QUERY' AND to_date(created_at) = DATE'2024-01-10'").agg(F.count("*").alias("queries_today"))
    one = F.lit(1)
    return users.withColumn("k", one).join(docs.withColumn("k", one), "k").join(asked.withColumn("k", one), "k").drop("k")  # one row each


@query("g16_department_summary", o("p_accounts p_departments", """WITH m AS (SELECT d.dept_id, d.name, count(a.account_id) AS members FROM p_departments d LEFT JOIN p_accounts a ON a.department_id = d.dept_id WHERE d.parent_id IS NOT NULL GROUP BY 1, 2)
    SELECT count(*) AS departments, CAST(sum(members) AS BIGINT) AS total_members, round(avg(members), 2) AS avg_members,
    (SELECT name FROM m ORDER BY members DESC, dept_id LIMIT 1) AS largest, (SELECT name FROM m ORDER BY members, dept_id LIMIT 1) AS smallest FROM m"""))
def _(t):
    own = t("p_accounts").groupBy(F.col("department_id").alias("dept_id")).agg(F.count("*").alias("n"))
    m = t("p_departments").where("parent_id is not null").join(own, "dept_id", "left").withColumn("members", F.coalesce("n", F.lit(0)))
    first = F.struct(F.col("members"), -F.col("dept_id"))
    least = F.struct(F.col("members"), F.col("dept_id"))
    return m.agg(F.count("*").alias("departments"), F.sum("members").alias("total_members"), F.round(F.avg("members"), 2).alias("avg_members"), F.max_by("name", first).alias("largest"), F.min_by("name", least).alias("smallest"))


@query("g17_permissions_by_resource", o("p_role_permissions", """SELECT split_part(code, '_', 1) AS resource, list(DISTINCT code ORDER BY code) AS codes, CAST(count(DISTINCT CASE WHEN role_id = 0 THEN code END) AS BIGINT) AS checked FROM p_role_permissions GROUP BY 1"""))
def _(t):
    resource = F.split_part("code", F.lit("_"), F.lit(1)).alias("resource")
    return t("p_role_permissions").groupBy(resource).agg(F.sort_array(F.collect_set("code")).alias("codes"), F.countDistinct(F.when(F.col("role_id") == 0, F.col("code"))).alias("checked"))


@query("g18_totals", o("p_documents", "SELECT CAST(sum(coalesce(file_size, 0)) AS BIGINT) AS total FROM p_documents"))
def _(t):
    return t("p_documents").agg(F.sum(F.coalesce("file_size", F.lit(0))).alias("total"))


@query("g19_group_hits", o("p_chunks", """WITH h AS (SELECT doc_id, chunk_id, row_number() OVER (ORDER BY embedding[1] DESC, chunk_id) AS rank FROM p_chunks)
    SELECT doc_id, list(chunk_id ORDER BY rank) AS details, CAST(min(rank) AS BIGINT) AS best FROM h WHERE rank <= 40 GROUP BY doc_id ORDER BY best LIMIT 10"""))
def _(t):
    hits = t("p_chunks").orderBy(F.get("embedding", F.lit(0)).desc(), "chunk_id").limit(40)  # a top-k report
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.get("embedding", F.lit(0)).desc(), "chunk_id")).cast("long"))
    groups = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x.chunk_id).alias("details"), F.min("rank").alias("best"))
    return groups.orderBy("best").limit(10)


@query("g21_chunk_statistics", "SELECT lang, count(*) AS n, CAST(sum(n_chars) // count(*) AS BIGINT) AS avg_chars, count(*) FILTER (WHERE n_chars > 2000) AS long FROM documents GROUP BY lang")
def _(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.floor(F.sum("n_chars") / F.count("*")).cast("long").alias("avg_chars"), F.count_if(F.col("n_chars") > 2000).alias("long"))


@query("g22_any_all", o("p_role_permissions", "SELECT role_id, bool_and(code LIKE 'document%') AS all_document, bool_or(code LIKE 'document%') AS any_document, min(code) AS first_code FROM p_role_permissions GROUP BY role_id"))
def _(t):
    doc = F.col("code").startswith("document")
    return t("p_role_permissions").groupBy("role_id").agg(F.bool_and(doc).alias("all_document"), F.bool_or(doc).alias("any_document"), F.min("code").alias("first_code"))


@query("g24_buckets", o("p_documents", "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN access_scope = 'department' AND department_id <> 0 THEN 'department' WHEN access_scope IN ('company', 'personal') THEN access_scope END AS bucket FROM p_documents) WHERE bucket IS NOT NULL GROUP BY 1"))
def _(t):
    scope = F.col("access_scope")
    bucket = F.when((scope == "department") & (F.col("department_id") != 0), "department").when(scope.isin("company", "personal"), scope)
    return t("p_documents").select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


@query("g25_tree_document_totals", o("p_folders p_documents", """WITH up(folder_id, anc) AS (SELECT folder_id, folder_id FROM p_folders UNION ALL SELECT u.folder_id, f.parent_id FROM up u JOIN p_folders f ON f.folder_id = u.anc WHERE f.parent_id IS NOT NULL)
    SELECT f.folder_id, CAST(count(d.doc_id) AS BIGINT) AS members FROM p_folders f LEFT JOIN up ON up.anc = f.folder_id LEFT JOIN p_documents d ON d.folder_id = up.folder_id AND NOT d.is_deleted GROUP BY 1""", recursive=True))
def _(t):
    return H.subtree_counts(t("p_folders"), R.base_scan(t("p_documents")), "folder_id", key="folder_id")


@query("w2_latest_messages", o("p_messages", "SELECT conversation_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS rn FROM p_messages) WHERE rn <= 10"))
def _(t):
    rn = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("turn")))
    return t("p_messages").withColumn("rn", rn).where("rn <= 10").select("conversation_id", "turn", "role").orderBy("conversation_id", "turn")


@query("w3_prompt_context", o("p_messages", "SELECT conversation_id, turn, role, CASE WHEN rn = 1 THEN 'PROMPT: ' || content ELSE content END AS content FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS rn FROM p_messages) WHERE rn <= 4"))
def _(t):
    rn = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("turn")))
    content = F.when(F.col("rn") == 1, F.concat(F.lit("PROMPT: "), "content")).otherwise(F.col("content"))
    return t("p_messages").withColumn("rn", rn).where("rn <= 4").select("conversation_id", "turn", "role", content.alias("content"))


@query("w4_linked_chunks", o("p_chunks", "SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM p_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)"))
def _(t):
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    return t("p_chunks").select("chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"))


@query("w5_chunk_index", o("p_chunks", "SELECT chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS chunk_index FROM p_chunks"))
def _(t):
    return t("p_chunks").select("chunk_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1).cast("long").alias("chunk_index"))


@query("w6_first_per_group", o("p_documents", "SELECT folder_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY file_size DESC, doc_id) AS rn FROM p_documents) WHERE rn = 1"))
def _(t):
    best = F.min(F.struct((-F.col("file_size")).alias("s"), "doc_id"))
    return t("p_documents").groupBy("folder_id").agg(best.alias("b")).select("folder_id", F.col("b.doc_id").alias("doc_id"))


@query("t3_task_failures", o("p_async_tasks", """SELECT task_id, CASE WHEN retry_count + 1 >= 3 THEN 'failed' ELSE 'retrying' END AS status, retry_count + 1 AS retry_count,
    CASE WHEN retry_count + 1 >= 3 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL 5 MINUTE * CAST(pow(2, retry_count + 1) AS INT) END AS next_retry_at FROM p_async_tasks WHERE status <> 'completed'"""))
def _(t):
    from docmill.streaming.tasks import fail

    return fail(t("p_async_tasks").where("status <> 'completed'"), "2024-01-01 00:00:00", 3).select("task_id", "status", "retry_count", "next_retry_at")


@query("r25_optimistic_lock", o("p_async_tasks", "SELECT count(*) AS updated FROM p_async_tasks WHERE retry_count = 2 AND status = 'pending'"))
def _(t):
    from docmill.streaming.tasks import compare_and_set

    return compare_and_set(t("p_async_tasks").where("status = 'pending'"), "retry_count", 2, status="processing").agg(F.count_if(F.col("status") == "processing").alias("updated"))


@query("t3_queue_states", """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, ts AS tick,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'start' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind FROM events),
r AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS rn, '' AS status, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS retry FROM e
  UNION ALL
  SELECT task_id, rn, CASE WHEN kind = 'create' AND w = '' THEN 'pending' WHEN kind = 'start' AND w = 'pending' THEN 'running' WHEN kind = 'complete' AND w = 'running' THEN 'completed' WHEN fails AND attempts >= 2 THEN 'failed' WHEN fails THEN 'retrying' ELSE w END,
    attempts + CAST(fails AS INTEGER), CASE WHEN fails AND attempts < 2 THEN tick + to_minutes(5 * CAST(pow(2, attempts + 1) AS BIGINT)) WHEN fails OR w <> status THEN NULL ELSE retry END
  FROM (SELECT *, kind = 'fail' AND w = 'running' AS fails FROM (SELECT e.task_id, e.rn, e.tick, e.kind, r.status, r.attempts, r.retry, CASE WHEN r.status = 'retrying' AND r.retry <= e.tick THEN 'pending' ELSE r.status END AS w FROM r JOIN e ON e.task_id = r.task_id AND e.rn = r.rn + 1)))
SELECT task_id, status, attempts, retry AS next_retry_at FROM r WHERE status <> '' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY rn DESC) = 1""")
def _(t):
    kind = F.create_map(*[F.lit(x) for x in ("signup", "create", "view", "start", "click", "progress", "purchase", "complete")])
    events = t("events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("fail")).alias("kind"), F.col("value").alias("percent"))
    return queue.states(queue.replay(events)).withColumn("next_retry_at", F.col("next_retry_at").cast("timestamp_ntz"))
