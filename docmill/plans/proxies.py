"""Entity views over the test tables, as one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PROXIES = {
    "p_departments": """SELECT CAST(1000 + r_regionkey AS BIGINT) AS dept_id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM region
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, CAST(1000 + n_regionkey AS BIGINT) FROM nation""",
    "p_accounts": """SELECT c_custkey AS account_id, c_name AS username, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS department_id,
        CASE WHEN c_custkey % 10 = 0 THEN 'blocked' WHEN c_custkey % 10 = 1 THEN 'inactive' ELSE 'active' END AS status, c_custkey % 13 = 0 AS is_deleted FROM customer""",
    "p_account_roles": "SELECT c_custkey AS account_id, c_custkey % 4 AS role_id FROM customer UNION SELECT c_custkey, c_custkey % 3 FROM customer",
    "p_roles": "SELECT CAST(role_id AS BIGINT) AS role_id, code FROM (VALUES (0,'admin'),(1,'manager'),(2,'user'),(3,'analyst')) AS t(role_id, code)",
    "p_role_permissions": """SELECT CAST(role_id AS BIGINT) AS role_id, code FROM (VALUES (0,'system_admin'),(0,'document_read'),(0,'document_delete'),
        (1,'document_read'),(1,'document_update'),(2,'document_read'),(3,'rag_query')) AS t(role_id, code)""",
    "p_folders": """SELECT p_partkey AS folder_id, p_name AS name, CASE WHEN p_partkey <= 1 THEN NULL ELSE CAST(FLOOR((p_partkey - 2) / 4.0) + 1 AS BIGINT) END AS parent_id,
        p_partkey % 25 AS department_id, CASE p_partkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'department' ELSE 'personal' END AS access_scope, p_partkey % 150 + 1 AS created_by FROM part""",
    "p_documents": """SELECT doc_id, source AS original_name, lang AS doc_language, n_chars AS file_size, doc_id % 150 + 1 AS uploader_id, doc_id % 25 AS department_id,
        doc_id % 200 + 1 AS folder_id, CASE doc_id % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'department' ELSE 'personal' END AS access_scope,
        CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, doc_id % 17 = 0 AS is_deleted FROM documents""",
    "p_document_permissions": """SELECT doc_id, 'account' AS subject_type, doc_id % 150 + 2 AS subject_id, CASE WHEN doc_id % 2 = 0 THEN 'deny' ELSE 'override' END AS precedence, 'write' AS permission FROM documents WHERE doc_id % 5 = 0
        UNION ALL SELECT doc_id, 'role', doc_id % 4, CASE WHEN doc_id % 3 = 0 THEN 'override' ELSE 'inherit' END, 'read' FROM documents WHERE doc_id % 7 = 0""",
    "p_folder_permissions": """SELECT p_partkey AS folder_id, 'role' AS subject_type, p_partkey % 4 AS subject_id,
        CASE p_partkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'delete' END AS permission FROM part WHERE p_partkey % 2 = 0""",
    "p_audit_logs": """SELECT event_id, user_id AS account_id, ts AS created_at, CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'purchase' THEN 'UPLOAD' WHEN 'view' THEN 'QUERY'
        WHEN 'click' THEN 'DOWNLOAD' ELSE 'DELETE' END AS action, event_type = 'error' AS is_failed, value, props FROM events""",
    "p_human_feedback": "SELECT doc_id AS message_id, CASE WHEN quality = 1 THEN 'upvote' ELSE 'downvote' END AS rating, toxic FROM labels",
    "p_messages": "SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations",
    "p_async_tasks": """SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'retrying' ELSE 'completed' END AS status,
        CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '3%' THEN 'normal' ELSE 'low' END AS priority,
        o_orderdate AS scheduled_at, o_orderkey % 4 AS retry_count FROM orders""",
    "p_chunks": "SELECT vec_id AS chunk_id, vec_id % 200 AS doc_id, CAST(label AS BIGINT) AS label, embedding FROM embeddings",
}


class Loader:
    """Loads test tables and entity views: t("documents"), t("p_documents")."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = PROXIES[name]
        for base in TABLES:
            if f"FROM {base}" in text:
                self(base).createOrReplaceTempView(base)
        return self.spark.sql(text)


def oracle(names: str, sql: str, recursive: bool = False) -> str:
    """DuckDB SQL with the named entity views as CTEs; sql begins with SELECT or with further CTEs after WITH."""
    views = [f"{n} AS ({PROXIES[n]})" for n in names.split()]
    sql = sql.strip()
    more = sql.upper().startswith("WITH ")
    rest = sql[5:] if more else sql
    if not views:
        return f"WITH {'RECURSIVE ' if recursive else ''}{rest}" if more else sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(views)}{', ' if more else ' '}{rest}"
