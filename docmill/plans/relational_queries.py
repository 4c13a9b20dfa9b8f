"""Scans, filters, probes, joins, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import relational as R
from docmill.plans.proxies import oracle as o
from docmill.plans.registry import query


@query("s1_base_scan", o("p_accounts", "SELECT * FROM p_accounts WHERE NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_accounts"))


@query("s2_scan_with_deleted", o("p_accounts", "SELECT * FROM p_accounts"))
def _(t):
    return R.base_scan(t("p_accounts"), with_deleted=True)


@query("s13_upsert", o("p_accounts", """SELECT coalesce(c.account_id, a.account_id) AS account_id, a.username, a.department_id, coalesce(c.status, a.status) AS status, a.is_deleted
    FROM p_accounts a FULL JOIN (SELECT account_id + 100 AS account_id, 'moved' AS status FROM p_accounts WHERE status = 'blocked') c ON a.account_id = c.account_id"""))
def _(t):
    changes = t("p_accounts").where("status = 'blocked'").select((F.col("account_id") + 100).alias("account_id"), F.lit("moved").alias("status"))
    return R.upsert(t("p_accounts"), changes, "account_id")


@query("s14_soft_delete", o("p_accounts", "SELECT account_id, username, department_id, status, is_deleted OR status = 'blocked' AS is_deleted FROM p_accounts"))
def _(t):
    return R.soft_delete(t("p_accounts"), t("p_accounts").where("status = 'blocked'"), "account_id")


@query("s14_restore", o("p_accounts", "SELECT account_id, username, department_id, status, is_deleted AND status <> 'active' AS is_deleted FROM p_accounts"))
def _(t):
    return R.restore(t("p_accounts"), F.col("status") == "active")


@query("s14_hard_delete", o("p_accounts", "SELECT * FROM p_accounts WHERE NOT is_deleted"))
def _(t):
    return R.hard_delete(t("p_accounts"), t("p_accounts").where("is_deleted"), "account_id")


@query("s19_bulk_size", o("p_documents", "SELECT CAST(sum(file_size) AS BIGINT) AS total_size FROM p_documents"))
def _(t):
    return t("p_documents").agg(F.sum("file_size").alias("total_size"))


@query("s16_delete_by_filter", o("p_chunks", "SELECT CAST(count(*) FILTER (WHERE label = 3) AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE label <> 3) AS BIGINT) AS kept FROM p_chunks"))
def _(t):
    return t("p_chunks").agg(F.count_if(F.col("label") == 3).alias("deleted"), F.count_if(F.col("label") != 3).alias("kept"))


@query("s17_collection_info", o("p_chunks", "SELECT count(*) AS points, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM p_chunks"))
def _(t):
    return t("p_chunks").agg(F.count("*").alias("points"), F.max(F.size("embedding")).cast("long").alias("dimension"))


@query("s21_monthly_partitions", o("p_audit_logs", "SELECT date_trunc('month', created_at)::TIMESTAMP AS month, count(*) AS n FROM p_audit_logs GROUP BY 1"))
def _(t):
    return t("p_audit_logs").groupBy(F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))


@query("f1_get_by_id", o("p_accounts", "SELECT * FROM p_accounts WHERE account_id = 7"))
def _(t):
    return R.get_by_id(t("p_accounts"), "account_id", 7)


@query("f2_first_by_filter", o("p_accounts", "SELECT * FROM p_accounts WHERE status = 'active' ORDER BY account_id LIMIT 1"))
def _(t):
    return R.first_by(t("p_accounts"), [F.col("account_id")], status="active")


@query("f3_list_by_filters", o("p_documents", "SELECT * FROM p_documents WHERE status = 'failed' AND department_id = 3"))
def _(t):
    return t("p_documents").where(R.equals(status="failed", department_id=3))


@query("f3_filter_is_null", o("p_accounts", "SELECT * FROM p_accounts WHERE department_id IS NULL"))
def _(t):
    return t("p_accounts").where(R.equals(department_id=None))


@query("f4_exists", o("p_accounts", "SELECT count(*) > 0 AS found FROM p_accounts WHERE status = 'blocked'"))
def _(t):
    return R.exists(t("p_accounts"), F.col("status") == "blocked")


@query("f5_documents_by_folder", o("p_documents", "SELECT * FROM p_documents WHERE folder_id = 12 AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_documents")).where(R.equals(folder_id=12))


@query("f5_documents_by_uploader", o("p_documents", "SELECT * FROM p_documents WHERE uploader_id = 9 AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_documents")).where(R.equals(uploader_id=9))


@query("f6_pending_work", o("p_documents", "SELECT doc_id, status FROM p_documents WHERE status IN ('pending', 'processing') AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_documents")).where(F.col("status").isin("pending", "processing")).orderBy(R.asc("doc_id")).select("doc_id", "status")


@query("f7_failed_documents", o("p_documents", "SELECT doc_id FROM p_documents WHERE status = 'failed' AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_documents")).where(R.equals(status="failed")).select("doc_id")


@query("f8_by_original_name", o("p_documents", "SELECT doc_id FROM p_documents WHERE original_name = 'src7' AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_documents")).where(R.equals(original_name="src7")).select("doc_id")


@query("f9_document_search", o("p_documents", "SELECT doc_id FROM p_documents WHERE (contains(upper(original_name), 'C1') OR contains(upper(doc_language), 'C1')) AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_documents")).where(R.contains(["original_name", "doc_language"], "c1")).select("doc_id")


@query("f10_folder_search", o("p_folders", "SELECT folder_id, name FROM p_folders WHERE contains(upper(name), '1_') IS NOT TRUE AND contains(upper(name), 'RT') AND department_id = 4"))
def _(t):
    rows = t("p_folders").where(R.contains(["name"], "rt") & ~R.contains(["name"], "1_") & (F.col("department_id") == 4))
    return rows.orderBy(R.asc("name"), R.asc("folder_id")).select("folder_id", "name")


@query("f11_user_search", o("p_accounts", "SELECT account_id FROM p_accounts WHERE (contains(upper(username), '12') OR contains(upper(status), '12')) AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_accounts")).where(R.contains(["username", "status"], "12")).select("account_id")


@query("f12_profile_search", o("p_accounts p_departments", """SELECT a.account_id, d.name AS department FROM p_accounts a JOIN p_departments d ON a.department_id = d.dept_id
    WHERE contains(upper(username), '00') AND status = 'active' AND NOT is_deleted"""))
def _(t):
    rows = R.base_scan(t("p_accounts")).where(R.contains(["username"], "00") & (F.col("status") == "active"))
    joined = rows.join(t("p_departments").select("dept_id", F.col("name").alias("department")), F.col("department_id") == F.col("dept_id"))
    return joined.orderBy(R.asc("username"), R.asc("account_id")).select("account_id", "department")


@query("f13_by_name_or_status", o("p_accounts", "SELECT account_id FROM p_accounts WHERE username = 'Customer#000000003' OR status = 'Customer#000000003' ORDER BY (username = 'Customer#000000003') DESC, account_id LIMIT 1"))
def _(t):
    x = "Customer#000000003"
    return t("p_accounts").where((F.col("username") == x) | (F.col("status") == x)).orderBy((F.col("username") == x).desc(), "account_id").limit(1).select("account_id")


@query("f14_active_users", o("p_accounts", "SELECT account_id FROM p_accounts WHERE status = 'active' AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_accounts")).where(R.equals(status="active")).select("account_id")


@query("f15_taken_by_other", o("p_accounts", "SELECT count(*) > 0 AS taken FROM p_accounts WHERE username = (SELECT username FROM p_accounts WHERE account_id = 5) AND account_id <> 5"))
def _(t):
    name = t("p_accounts").where("account_id = 5").select("username")
    return R.exists(R.semi(t("p_accounts"), name, "username"), F.col("account_id") != 5, "taken")


@query("f16_admin_roles", o("p_roles", "SELECT role_id, code FROM p_roles WHERE code IN ('admin', 'manager')"))
def _(t):
    return t("p_roles").where(F.col("code").isin("admin", "manager"))


@query("f17_permissions_by_resource", o("p_role_permissions", "SELECT DISTINCT code FROM p_role_permissions WHERE split_part(code, '_', 1) = 'document'"))
def _(t):
    return t("p_role_permissions").where(F.split_part("code", F.lit("_"), F.lit(1)) == "document").select("code").distinct()


@query("f18_departments_by_parent", o("p_departments", "SELECT dept_id, name FROM p_departments WHERE parent_id = 1002"))
def _(t):
    return t("p_departments").where("parent_id = 1002").select("dept_id", "name")


@query("f19_get_or_create_default", o("p_departments", "SELECT dept_id, name FROM p_departments WHERE name = 'DEFAULT' UNION ALL SELECT CAST(-1 AS BIGINT), 'DEFAULT' WHERE NOT EXISTS (SELECT 1 FROM p_departments WHERE name = 'DEFAULT')"))
def _(t):
    found = t("p_departments").where("name = 'DEFAULT'").select("dept_id", "name")
    new = t.spark.range(1).select(F.lit(-1).cast("long").alias("dept_id"), F.lit("DEFAULT").alias("name"))
    return found.unionByName(new.join(found.select("name"), "name", "left_anti").select("dept_id", "name"))


@query("f20_queued_tasks", o("p_async_tasks", "SELECT task_id, scheduled_at FROM p_async_tasks WHERE status = 'pending' ORDER BY scheduled_at DESC, task_id LIMIT 50"))
def _(t):
    return t("p_async_tasks").where("status = 'pending'").orderBy(R.desc("scheduled_at"), R.asc("task_id")).limit(50).select("task_id", "scheduled_at")


@query("f21_task_status", o("p_async_tasks", "SELECT task_id, status IN ('completed', 'failed') AS is_finished, status IN ('running', 'retrying') AS is_running FROM p_async_tasks"))
def _(t):
    return t("p_async_tasks").select("task_id", F.col("status").isin("completed", "failed").alias("is_finished"), F.col("status").isin("running", "retrying").alias("is_running"))


@query("f22_owned_conversation", o("p_messages", "SELECT conversation_id, turn, role, content FROM p_messages WHERE conversation_id = 4 AND conversation_id % 3 = 1"))
def _(t):
    return t("p_messages").where((F.col("conversation_id") == 4) & (F.col("conversation_id") % 3 == 1))


@query("f23_valid_tokens", o("p_async_tasks", "SELECT task_id FROM p_async_tasks WHERE status <> 'completed' AND scheduled_at > TIMESTAMP '1997-06-01'"))
def _(t):
    return t("p_async_tasks").where("status <> 'completed' AND scheduled_at > TIMESTAMP_NTZ'1997-06-01'").select("task_id")


@query("f24_purge_expired", o("p_async_tasks", "SELECT status, count(*) AS purged FROM p_async_tasks WHERE scheduled_at <= TIMESTAMP '1997-06-01' GROUP BY status"))
def _(t):
    return t("p_async_tasks").where("scheduled_at <= TIMESTAMP_NTZ'1997-06-01'").groupBy("status").agg(F.count("*").alias("purged"))


@query("f25_profiles_by_department", o("p_accounts", "SELECT account_id, username FROM p_accounts WHERE department_id = 6 AND NOT is_deleted"))
def _(t):
    return R.base_scan(t("p_accounts")).where("department_id = 6").orderBy("username", "account_id").select("account_id", "username")


@query("f26_json_path_equality", o("p_audit_logs", "SELECT event_id FROM p_audit_logs WHERE json_extract_string(props, '$.k') = '42'"))
def _(t):
    return t("p_audit_logs").where(F.get_json_object("props", "$.k") == "42").select("event_id")


@query("f27_multi_criteria", o("p_documents", "SELECT doc_id FROM p_documents WHERE status = 'completed' AND access_scope = 'company' AND contains(upper(original_name), 'SRC1') AND NOT is_deleted"))
def _(t):
    rows = R.base_scan(t("p_documents")).where(R.equals(status="completed", access_scope="company") & R.contains(["original_name"], "src1"))
    return rows.select("doc_id")


@query("f28_audit_filter", o("p_audit_logs", "SELECT event_id FROM p_audit_logs WHERE action = 'LOGIN' AND account_id = 3 AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'"))
def _(t):
    return t("p_audit_logs").where("action = 'LOGIN' AND account_id = 3 AND created_at >= TIMESTAMP_NTZ'2024-01-05' AND created_at < TIMESTAMP_NTZ'2024-01-20'").select("event_id")


@query("j1_document_details", o("p_documents p_accounts p_departments p_folders", """SELECT d.doc_id, a.username AS uploader, p.name AS department, f.name AS folder FROM p_documents d
    LEFT JOIN p_accounts a ON a.account_id = d.uploader_id LEFT JOIN p_departments p ON p.dept_id = d.department_id LEFT JOIN p_folders f ON f.folder_id = d.folder_id WHERE NOT d.is_deleted"""))
def _(t):
    d = R.base_scan(t("p_documents"))
    d = d.join(t("p_accounts").select(F.col("account_id").alias("uploader_id"), F.col("username").alias("uploader")), "uploader_id", "left")
    d = d.join(t("p_departments").select(F.col("dept_id").alias("department_id"), F.col("name").alias("department")), "department_id", "left")
    d = d.join(t("p_folders").select("folder_id", F.col("name").alias("folder")), "folder_id", "left")
    return d.select("doc_id", "uploader", "department", "folder")


@query("j2_roles_with_permissions", o("p_roles p_role_permissions", "SELECT r.code AS role, list(p.code ORDER BY p.code) AS permissions FROM p_roles r JOIN p_role_permissions p USING (role_id) GROUP BY r.code"))
def _(t):
    joined = t("p_roles").withColumnRenamed("code", "role").join(t("p_role_permissions"), "role_id")
    return R.nested(joined, ["role"], F.col("code"), "permissions")


@query("j3_documents_with_chunks", o("p_documents p_chunks", "SELECT d.doc_id, list(c.chunk_id ORDER BY c.chunk_id) AS chunks FROM p_documents d JOIN p_chunks c USING (doc_id) WHERE NOT d.is_deleted GROUP BY d.doc_id"))
def _(t):
    return R.nested(R.base_scan(t("p_documents")).select("doc_id").join(t("p_chunks").select("doc_id", "chunk_id"), "doc_id"), ["doc_id"], F.col("chunk_id"), "chunks")


@query("j4_accounts_with_role", o("p_accounts p_account_roles", "SELECT account_id FROM p_accounts WHERE NOT is_deleted AND account_id IN (SELECT account_id FROM p_account_roles WHERE role_id = 0)"))
def _(t):
    return R.semi(R.base_scan(t("p_accounts")), t("p_account_roles").where("role_id = 0"), "account_id").select("account_id")


@query("j5_accounts_in_department", o("p_accounts p_departments", "SELECT account_id FROM p_accounts WHERE department_id IN (SELECT dept_id FROM p_departments WHERE parent_id = 1001) AND NOT is_deleted"))
def _(t):
    depts = t("p_departments").where("parent_id = 1001").select(F.col("dept_id").alias("department_id"))
    return R.semi(R.base_scan(t("p_accounts")), depts, "department_id").select("account_id")


@query("j6_role_permission_codes", o("p_role_permissions", "SELECT DISTINCT code FROM p_role_permissions WHERE role_id IN (0, 1)"))
def _(t):
    return t("p_role_permissions").where("role_id IN (0, 1)").select("code").distinct()


_SETS = "SELECT DISTINCT account_id, code FROM p_account_roles JOIN p_role_permissions USING (role_id)"


def _sets(t):
    return t("p_account_roles").join(F.broadcast(t("p_role_permissions")), "role_id").select("account_id", "code").distinct()  # seven rows, fixed


@query("j7_account_permissions", o("p_account_roles p_role_permissions", _SETS))
def _(t):
    return _sets(t)


@query("j8_has_any", o("p_account_roles p_role_permissions", f"WITH s AS ({_SETS}) SELECT DISTINCT account_id FROM s WHERE code IN ('document_delete', 'rag_query')"))
def _(t):
    return _sets(t).where("code IN ('document_delete', 'rag_query')").select("account_id").distinct()


@query("j8_has_all", o("p_account_roles p_role_permissions", f"WITH s AS ({_SETS}) SELECT account_id FROM s WHERE code IN ('document_read', 'document_update') GROUP BY account_id HAVING count(*) = 2"))
def _(t):
    return R.has_all(_sets(t), "account_id", "code", ["document_read", "document_update"])


@query("j9_user_roles", o("p_account_roles p_roles", "SELECT account_id, code FROM p_account_roles JOIN p_roles USING (role_id)"))
def _(t):
    return t("p_account_roles").join(t("p_roles"), "role_id").select("account_id", "code")


@query("j10_roles_that_grant", o("p_account_roles p_roles p_role_permissions", """SELECT account_id, list(DISTINCT r.code ORDER BY r.code) AS roles FROM p_account_roles ar JOIN p_roles r USING (role_id)
    JOIN p_role_permissions p USING (role_id) WHERE p.code = 'document_read' GROUP BY account_id"""))
def _(t):
    grants = t("p_role_permissions").where("code = 'document_read'").select("role_id")
    joined = t("p_account_roles").join(R.semi(t("p_roles"), grants, "role_id"), "role_id")
    return joined.groupBy("account_id").agg(F.sort_array(F.collect_set("code")).alias("roles"))


@query("j12_subject_names", o("p_document_permissions p_accounts p_roles", """SELECT p.doc_id, p.subject_type, p.subject_id, coalesce(a.username, r.code, 'Unknown') AS subject_name FROM p_document_permissions p
    LEFT JOIN p_accounts a ON p.subject_type = 'account' AND a.account_id = p.subject_id LEFT JOIN p_roles r ON p.subject_type = 'role' AND r.role_id = p.subject_id"""))
def _(t):
    names = t("p_accounts").select(F.lit("account").alias("subject_type"), F.col("account_id").alias("subject_id"), F.col("username").alias("subject_name"))
    names = names.unionByName(t("p_roles").select(F.lit("role").alias("subject_type"), F.col("role_id").alias("subject_id"), F.col("code").alias("subject_name")))
    joined = t("p_document_permissions").join(names, ["subject_type", "subject_id"], "left")
    return joined.select("doc_id", "subject_type", "subject_id", F.coalesce("subject_name", F.lit("Unknown")).alias("subject_name"))


@query("j13_department_documents", o("p_documents p_folders", """SELECT DISTINCT d.doc_id FROM p_documents d LEFT JOIN p_folders f USING (folder_id)
    WHERE (d.department_id = 5 OR f.department_id = 5) AND NOT d.is_deleted"""))
def _(t):
    docs = R.base_scan(t("p_documents"))
    through = R.semi(docs, t("p_folders").where("department_id = 5"), "folder_id").select("doc_id")
    return docs.where("department_id = 5").select("doc_id").union(through).distinct()


@query("j18_self_join", o("p_folders", "SELECT c.folder_id, c.name, p.name AS parent_name FROM p_folders c JOIN p_folders p ON p.folder_id = c.parent_id"))
def _(t):
    parent = t("p_folders").select(F.col("folder_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return t("p_folders").join(parent, "parent_id").select("folder_id", "name", "parent_name")


@query("j19_missing_links", o("p_accounts p_account_roles", "SELECT account_id, CAST(2 AS BIGINT) AS role_id FROM p_accounts WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM p_account_roles r WHERE r.account_id = p_accounts.account_id AND r.role_id = 2)"))
def _(t):
    wanted = t("p_accounts").where("status = 'active'").select("account_id", F.lit(2).cast("long").alias("role_id"))
    return R.missing_links(t("p_account_roles"), wanted, ["account_id", "role_id"])


@query("j20_replace_set", o("p_role_permissions", """WITH w AS (SELECT * FROM (VALUES ('document_read'), ('rag_query')) AS v(code)), h AS (SELECT code FROM p_role_permissions WHERE role_id = 0)
    SELECT code, 'add' AS change FROM w WHERE code NOT IN (SELECT code FROM h) UNION ALL SELECT code, 'remove' FROM h WHERE code NOT IN (SELECT code FROM w)"""))
def _(t):
    wanted = t.spark.createDataFrame([("document_read",), ("rag_query",)], "code string")
    return R.replace_set(t("p_role_permissions").where("role_id = 0").select("code"), wanted, ["code"])


@query("j21_revoke_role", o("p_account_roles", "SELECT role_id, count(*) AS links FROM p_account_roles WHERE role_id <> 1 GROUP BY role_id"))
def _(t):
    return R.hard_delete(t("p_account_roles"), t("p_roles").where("code = 'manager'").select("role_id"), "role_id").groupBy("role_id").agg(F.count("*").alias("links"))


@query("j23_key_remap", o("p_account_roles", "SELECT account_id, role_id + 100 AS role_id FROM p_account_roles"))
def _(t):
    mapping = t("p_roles").select(F.col("role_id").alias("old_id"), (F.col("role_id") + 100).alias("new_id"))
    return R.remap(t("p_account_roles"), mapping, "role_id").select("account_id", "role_id")


@query("j24_duplicates", o("p_documents", "SELECT original_name, count(*) AS n FROM p_documents GROUP BY 1 HAVING count(*) > 1"))
def _(t):
    return R.duplicates(t("p_documents"), "original_name")


@query("l1_page_clamped", o("p_documents", "SELECT doc_id FROM (SELECT doc_id FROM p_documents WHERE NOT is_deleted ORDER BY doc_id DESC) OFFSET ((SELECT count(*) - 1 FROM p_documents WHERE NOT is_deleted) // 20 * 20) LIMIT 20"))
def _(t):
    return R.page(R.base_scan(t("p_documents")), [R.desc("doc_id")], 10**6, 20).select("doc_id")


@query("l2_user_search_page", o("p_accounts", "SELECT account_id FROM p_accounts WHERE contains(upper(username), '1') AND NOT is_deleted ORDER BY username, account_id LIMIT 10 OFFSET 10"))
def _(t):
    return R.page(R.base_scan(t("p_accounts")).where(R.contains(["username"], "1")), [R.asc("username"), R.asc("account_id")], 2, 10).select("account_id")


@query("l3_page_past_end", o("p_roles", "SELECT role_id, code FROM p_roles ORDER BY role_id LIMIT 10 OFFSET 20"))
def _(t):
    return R.page(t("p_roles"), [R.asc("role_id")], 3, 10, clamp=False)


@query("l3_total_pages", o("p_accounts", "SELECT count(*) AS total_items, CAST((count(*) + 19) // 20 AS BIGINT) AS total_pages FROM p_accounts"))
def _(t):
    return R.page_info(t("p_accounts"), 20)


@query("l8_keyset_page", o("p_audit_logs", "SELECT event_id, created_at FROM p_audit_logs WHERE (created_at, event_id) < (TIMESTAMP '2024-01-15', 0) ORDER BY created_at DESC, event_id DESC LIMIT 25"))
def _(t):
    return R.after_key(t("p_audit_logs"), "created_at", "event_id", ("2024-01-15", 0), 25).select("event_id", "created_at")


@query("l9_newest_actions", o("p_audit_logs", "SELECT event_id FROM p_audit_logs WHERE account_id = 3 ORDER BY created_at DESC, event_id LIMIT 20"))
def _(t):
    return t("p_audit_logs").where("account_id = 3").orderBy(R.desc("created_at"), R.asc("event_id")).limit(20).select("event_id")


@query("l9_failed_actions", o("p_audit_logs", "SELECT event_id FROM p_audit_logs WHERE is_failed ORDER BY created_at DESC, event_id LIMIT 20"))
def _(t):
    return t("p_audit_logs").where("is_failed").orderBy(R.desc("created_at"), R.asc("event_id")).limit(20).select("event_id")


@query("l10_messages_page", o("p_messages", "SELECT role, content FROM p_messages WHERE conversation_id = 3 ORDER BY turn LIMIT 3 OFFSET 1"))
def _(t):
    return t("p_messages").where("conversation_id = 3").orderBy("turn").offset(1).limit(3).select("role", "content")


@query("l12_queue_poll", o("p_async_tasks", """SELECT task_id, priority FROM p_async_tasks WHERE status IN ('pending', 'retrying')
    ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END DESC, scheduled_at, task_id LIMIT 10"""))
def _(t):
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "normal", 2).otherwise(1)
    return t("p_async_tasks").where("status IN ('pending', 'retrying')").orderBy(rank.desc(), R.asc("scheduled_at"), "task_id").limit(10).select("task_id", "priority")


@query("l13_department_sort", o("p_departments", "SELECT dept_id, name, row_number() OVER (ORDER BY name, dept_id) AS place FROM p_departments"))
def _(t):
    from pyspark.sql import Window

    return t("p_departments").select("dept_id", "name", F.row_number().over(Window.orderBy(F.collate("name", "vi"), "dept_id")).cast("long").alias("place"))  # a few departments


@query("l16_activity_timeline", o("p_audit_logs", "SELECT event_id, action, created_at FROM p_audit_logs WHERE account_id = 5 AND created_at > TIMESTAMP '2024-01-30' - INTERVAL 20 DAY"))
def _(t):
    return t("p_audit_logs").where("account_id = 5 AND created_at > TIMESTAMP_NTZ'2024-01-30' - INTERVAL 20 DAY").orderBy(R.desc("created_at"), "event_id").select("event_id", "action", "created_at")


@query("u1_union_distinct", o("p_documents p_document_permissions p_folders", """SELECT doc_id FROM p_documents WHERE uploader_id = 8 UNION SELECT doc_id FROM p_document_permissions WHERE subject_type = 'account' AND subject_id = 8
    UNION SELECT doc_id FROM p_documents JOIN p_folders USING (folder_id) WHERE p_folders.created_by = 8"""))
def _(t):
    docs = t("p_documents")
    own = docs.where("uploader_id = 8").select("doc_id")
    granted = t("p_document_permissions").where("subject_type = 'account' AND subject_id = 8").select("doc_id")
    return own.union(granted).union(R.semi(docs, t("p_folders").where("created_by = 8"), "folder_id").select("doc_id")).distinct()


@query("u2_intersect", o("p_documents p_chunks", "SELECT doc_id FROM p_documents WHERE access_scope = 'company' INTERSECT SELECT doc_id FROM p_chunks"))
def _(t):
    return t("p_documents").where("access_scope = 'company'").select("doc_id").intersect(t("p_chunks").select("doc_id"))


@query("u3_except", o("p_documents p_document_permissions", "SELECT doc_id FROM p_documents EXCEPT SELECT doc_id FROM p_document_permissions WHERE precedence = 'deny'"))
def _(t):
    return t("p_documents").select("doc_id").distinct().join(t("p_document_permissions").where("precedence = 'deny'"), "doc_id", "left_anti")


@query("u4_union_all", o("p_documents p_accounts", "SELECT 'documents' AS entity, count(*) AS deleted FROM p_documents WHERE is_deleted UNION ALL SELECT 'accounts', count(*) FROM p_accounts WHERE is_deleted"))
def _(t):
    count = lambda name, df: df.where("is_deleted").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("entity"), "deleted")
    return count("documents", t("p_documents")).unionByName(count("accounts", t("p_accounts")))


@query("u5_permission_names", o("p_account_roles p_role_permissions", f"WITH s AS ({_SETS}) SELECT account_id, list(code ORDER BY code) AS codes FROM s GROUP BY account_id"))
def _(t):
    lists = t("p_role_permissions").groupBy("role_id").agg(F.collect_list("code").alias("codes"))
    return t("p_account_roles").join(lists, "role_id").groupBy("account_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))


@query("u6_permission_change", o("", "SELECT ['rag_query'] AS added, ['document_update'] AS removed"))
def _(t):
    sets = t.spark.range(1).select(F.array(F.lit("document_read"), F.lit("document_update")).alias("old"), F.array(F.lit("document_read"), F.lit("rag_query")).alias("new"))
    return sets.select(F.array_except("new", "old").alias("added"), F.array_except("old", "new").alias("removed"))
