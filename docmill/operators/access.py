"""Access control: scopes, grants with precedence, and their materialisation.

Permission levels are read 1, write 2, delete 3; a grant serves every need up to
its level. A deny for the account or any of its roles wins by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmill.operators.hierarchy import ancestors
from docmill.operators.lineage import cut, small

LEVELS = {"read": 1, "write": 2, "delete": 3}
#: Accounts of equal roles that are expanded together.
BLOCK = 512


def level(permission: Column) -> Column:
    """The number of a permission level."""
    return F.when(permission == "read", 1).when(permission == "write", 2).when(permission == "delete", 3)


def accessible_documents(documents: DataFrame, account, department, admin: bool = False) -> DataFrame:
    """Documents by scope: company, own department (all departments' without one), and own personal ones; an admin sees all."""
    if admin:
        return documents
    same = F.lit(True) if department is None else F.col("department_id") == department
    scope = F.col("access_scope")
    return documents.where((scope == "company") | ((scope == "department") & same) | ((scope == "personal") & (F.col("uploader_id") == account)))


def accessible_folders(folders: DataFrame, account, department, admin: bool = False) -> DataFrame:
    """Folders by scope; without a department only department folders without one (null-safe equality)."""
    if admin:
        return folders
    scope = F.col("access_scope")
    same = F.col("department_id").eqNullSafe(F.lit(department).cast("long"))
    return folders.where((scope == "company") | ((scope == "department") & same) | ((scope == "personal") & (F.col("created_by") == account)))


def subjects(accounts: DataFrame, account_roles: DataFrame) -> DataFrame:
    """``(account_id, subject_type, subject_id)``: each account as itself and as each of its roles."""
    own = accounts.select("account_id", F.lit("account").alias("subject_type"), F.col("account_id").alias("subject_id"))
    roles = account_roles.join(accounts.select("account_id"), "account_id", "left_semi").select("account_id", F.lit("role").alias("subject_type"), F.col("role_id").alias("subject_id"))
    return own.unionByName(roles)


def folder_grants(subject_rows: DataFrame, permissions: DataFrame) -> DataFrame:
    """``(account_id, folder_id, folder_level)``: the highest folder grant of each account."""
    return subject_rows.join(permissions, ["subject_type", "subject_id"]).groupBy("account_id", "folder_id").agg(F.max(level(F.col("permission"))).alias("folder_level"))


def role_sets(subject_rows: DataFrame) -> DataFrame:
    """``(account_id, roles)``: the sorted array of each account's roles (empty for none)."""
    role = F.when(F.col("subject_type") == "role", F.col("subject_id"))
    return subject_rows.groupBy("account_id").agg(F.sort_array(F.collect_set(role)).alias("roles"))


def decided_sets(subject_rows: DataFrame, documents: DataFrame, document_permissions: DataFrame, folder_permissions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The accounts' role sets; what ACL rows of roles give each set, ``(roles, doc_id, denied, override_level, folder_level)``; what the accounts' own rows give, ``(account_id, doc_id, own_denied, own_level, own_folder)``."""
    deny, over = F.col("precedence") == "deny", F.when(F.col("precedence") == "override", level(F.col("permission")))
    docs = documents.select("doc_id", "folder_id")
    sets = cut(role_sets(subject_rows))
    held = sets.select("roles").distinct().select("roles", F.explode("roles").alias("subject_id"))

    def of(permissions: DataFrame, kind: str) -> DataFrame:
        return permissions.where(F.col("subject_type") == kind)

    direct = held.join(of(document_permissions, "role"), "subject_id").groupBy("roles", "doc_id").agg(F.bool_or(deny).alias("denied"), F.max(over).alias("override_level"))
    by_folder = held.join(of(folder_permissions, "role"), "subject_id").groupBy("roles", "folder_id").agg(F.max(level(F.col("permission"))).alias("folder_level"))
    by_folder = by_folder.join(docs, "folder_id").select("roles", "doc_id", "folder_level")
    by_roles = direct.join(by_folder, ["roles", "doc_id"], "full_outer").join(docs.select("doc_id"), "doc_id", "left_semi").select("roles", "doc_id", "denied", "override_level", "folder_level")

    own = subject_rows.where(F.col("subject_type") == "account").select("account_id", "subject_id")
    own_rows = own.join(of(document_permissions, "account"), "subject_id").groupBy("account_id", "doc_id").agg(F.bool_or(deny).alias("own_denied"), F.max(over).alias("own_level"))
    own_folders = own.join(of(folder_permissions, "account"), "subject_id").groupBy("account_id", "folder_id").agg(F.max(level(F.col("permission"))).alias("own_folder"))
    own_folders = own_folders.join(docs, "folder_id").select("account_id", "doc_id", "own_folder")
    own_pairs = own_rows.join(own_folders, ["account_id", "doc_id"], "full_outer").join(docs.select("doc_id"), "doc_id", "left_semi")
    return sets, by_roles, own_pairs.select("account_id", "doc_id", "own_denied", "own_level", "own_folder")


def expanded(rows: DataFrame, members: DataFrame, but: DataFrame) -> DataFrame:
    """Rows ``(roles, doc_id, ..)`` for each account of members ``(account_id, roles)`` with these roles, without the pairs ``(account_id, doc_id)`` of but.

    Accounts with equal roles stand in blocks of about BLOCK, and what moves is
    a row for each block and document. A block's accounts come in one order for
    each of its documents, one document after the other: no pair is shuffled,
    and files of the pairs stay small, as they repeat what is close by. Where
    there are few blocks, their documents are dealt over several tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = small(cut(members.groupBy("roles").agg(F.ceil(F.count("account_id") / BLOCK).cast("int").alias("_blocks"))))
    block = F.pmod(F.xxhash64("account_id"), F.col("_blocks")).cast("int").alias("_block")
    placed = members.join(counts, "roles").select("account_id", "roles", block)
    slices = max(1, -(-8 * parts // max(1, counts.agg(F.sum("_blocks")).first()[0] or 0)))
    key = ["roles", "_block", "_slice"]
    blocks = placed.groupBy("roles", "_block").agg(F.sort_array(F.collect_list("account_id")).alias("_accounts")).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    out = but.select("account_id", "doc_id").distinct().join(placed, "account_id").groupBy("roles", "_block", "doc_id").agg(F.collect_list("account_id").alias("_but"))
    every = rows.join(counts, "roles").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    every = every.join(small(out), ["roles", "_block", "doc_id"], "left").withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))
    met = every.repartition(parts, *key).join(blocks.repartition(parts, *key).hint("merge"), key)
    here = F.when(F.col("_but").isNull(), F.col("_accounts")).otherwise(F.array_except("_accounts", "_but"))
    return met.select(F.explode(here).alias("account_id"), *[c for c in rows.columns if c != "roles"])


def decisions(subject_rows: DataFrame, documents: DataFrame, document_permissions: DataFrame, folder_permissions: DataFrame) -> DataFrame:
    """``(account_id, doc_id, denied, override_level, folder_level, own_denied, own_level)`` for every pair that some ACL row touches.

    ACL rows of roles are folded for each distinct set of roles, not for each
    account: that is one small aggregation, and only its result is expanded to
    accounts, block by block. Pairs with rows of the account's own are folded
    apart. Pairs without any ACL row are denied by default and stay out.
    """
    sets, by_roles, own_pairs = decided_sets(subject_rows, documents, document_permissions, folder_permissions)
    both = own_pairs.join(sets, "account_id").join(by_roles, ["roles", "doc_id"], "left")
    both = both.select("account_id", "doc_id", F.greatest("denied", "own_denied").alias("denied"), F.greatest("override_level", "own_level").alias("override_level"), F.greatest("folder_level", "own_folder").alias("folder_level"), "own_denied", "own_level")
    rest = expanded(by_roles, sets, own_pairs)
    rest = rest.select("account_id", "doc_id", "denied", "override_level", "folder_level", F.lit(None).cast("boolean").alias("own_denied"), F.lit(None).cast("int").alias("own_level"))
    return rest.unionByName(both)


def decided_counts(subject_rows: DataFrame, documents: DataFrame, document_permissions: DataFrame, folder_permissions: DataFrame) -> DataFrame:
    """``(account_id, rows)``: how many rows of decisions each account has, if any; counted for each set of roles, no pair is made but those with rows of the account's own."""
    sets, by_roles, own_pairs = decided_sets(subject_rows, documents, document_permissions, folder_permissions)
    every = sets.join(small(by_roles.groupBy("roles").agg(F.count("*").alias("n"))), "roles").select("account_id", "n")
    own = own_pairs.join(sets, "account_id").join(by_roles.groupBy("roles", "doc_id").agg(F.count("*").alias("_same")), ["roles", "doc_id"], "left")
    # a pair's rows are all made with the account's own row, each of them, instead of without
    own = own.groupBy("account_id", "doc_id").agg(F.sum(F.coalesce("_same", F.lit(1))).alias("with"), F.coalesce(F.first("_same"), F.lit(0)).alias("without"))
    own = own.select("account_id", (F.col("with") - F.col("without")).alias("n"))
    return every.unionByName(own).groupBy("account_id").agg(F.sum("n").alias("rows")).where("rows > 0")


def allowed(decided: DataFrame, need: str = "read", account_first: bool = False) -> DataFrame:
    """``(account_id, doc_id, allowed)``: deny, else override, else folder, else no.

    With account_first the account's own rows decide before its roles' do.
    """
    n = LEVELS[need]
    denied = F.coalesce("denied", F.lit(False))
    over = F.coalesce(F.col("override_level") >= n, F.lit(False))
    folder = F.coalesce(F.col("folder_level") >= n, F.lit(False))
    rule = F.when(denied, False).when(over, True).otherwise(folder)
    if account_first:
        rule = F.when(F.coalesce("own_denied", F.lit(False)), False).when(F.coalesce(F.col("own_level") >= n, F.lit(False)), True).otherwise(rule)
    return decided.select("account_id", "doc_id", rule.alias("allowed"))


def max_permission(decided: DataFrame) -> DataFrame:
    """``(account_id, doc_id, max_permission)``: deny, the override's level, the folder's level or none."""
    best = F.coalesce("override_level", "folder_level")
    name = F.when(best == 1, "read").when(best == 2, "write").when(best == 3, "delete").otherwise("none")
    return decided.select("account_id", "doc_id", F.when(F.coalesce("denied", F.lit(False)), "deny").otherwise(name).alias("max_permission"))


def listed_documents(documents: DataFrame, decided: DataFrame, account, department) -> DataFrame:
    """Documents of the list rule: not denied, and override, folder grant, company scope or own department."""
    own = decided.where(F.col("account_id") == account)
    denied = own.where("denied").select("doc_id")
    granted = own.where("override_level is not null or folder_level is not null").select("doc_id", F.lit(True).alias("granted"))
    rows = documents.join(denied, "doc_id", "left_anti").join(granted, "doc_id", "left")
    scope = F.col("access_scope")
    own_department = F.coalesce((scope == "department") & (F.col("department_id") == F.lit(department).cast("long")), F.lit(False))
    return rows.where(F.coalesce("granted", F.lit(False)) | (scope == "company") | own_department).drop("granted")


def check_requests(requests: DataFrame, accounts: DataFrame, documents: DataFrame, folders: DataFrame, subject_rows: DataFrame, document_permissions: DataFrame, folder_permissions: DataFrame, role_accounts: DataFrame, need: str) -> DataFrame:
    """Requests ``(request, account_id, doc_id)`` with ``allowed`` and the ``reason``, the first rule that applies.

    An inactive (or unknown) account is refused, the uploader is let in, a deny
    row refuses, an explicit grant of the level, a role of ``role_accounts``, and
    the nearest folder grant of the level up to 10 folders above let in; nothing
    else does. Grants are looked up for what is asked only.
    """
    n = LEVELS[need]
    rows = requests.join(accounts.select("account_id", ((F.col("status") == "active") & ~F.col("is_deleted")).alias("active")), "account_id", "left")
    rows = rows.join(documents.select("doc_id", "uploader_id", "folder_id"), "doc_id", "left")
    deny, over = F.col("precedence") == "deny", F.when(F.col("precedence") == "override", level(F.col("permission")))
    direct = requests.select("account_id", "doc_id").distinct().join(subject_rows, "account_id").join(document_permissions, ["doc_id", "subject_type", "subject_id"])
    direct = direct.groupBy("account_id", "doc_id").agg(F.bool_or(deny).alias("denied"), F.max(over).alias("explicit"))
    above = rows.select("account_id", "folder_id").distinct().join(ancestors(folders, depth=10), "folder_id").join(subject_rows, "account_id")
    above = above.join(folder_permissions.withColumnRenamed("folder_id", "ancestor"), ["ancestor", "subject_type", "subject_id"])
    above = above.groupBy("account_id", "folder_id", "hops").agg(F.max(level(F.col("permission"))).alias("best"))
    above = above.groupBy("account_id", "folder_id").agg(F.min_by("best", "hops").alias("inherited"))
    role = role_accounts.select("account_id").distinct().withColumn("by_role", F.lit(True))
    rows = rows.join(direct, ["account_id", "doc_id"], "left").join(role, "account_id", "left").join(above, ["account_id", "folder_id"], "left")
    reason = (
        F.when(~F.coalesce("active", F.lit(False)), "inactive")
        .when(F.col("uploader_id") == F.col("account_id"), "uploader")
        .when(F.col("denied"), "deny")
        .when(F.col("explicit") >= n, "explicit")
        .when(F.col("by_role"), "role")
        .when(F.col("inherited") >= n, "folder")
        .otherwise("none")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select(*requests.columns, F.col("reason").isin("uploader", "explicit", "role", "folder").alias("allowed"), "reason")


def document_keys(documents: DataFrame, document_permissions: DataFrame, need: str = "read") -> DataFrame:
    """``(doc_id, keys, denied)``: the keys any of which opens a document, and those any of which shuts it; sorted arrays.

    The key of its scope (of the company, its department or its uploader), and
    those of the accounts and roles with an override of the level. Documents of
    a department also have the key of accounts without one. An array is as long
    as the document has ACL rows.
    """
    subject = F.concat(F.when(F.col("subject_type") == "role", "r:").otherwise("a:"), F.col("subject_id").cast("string"))
    over = (F.col("precedence") == "override") & (level(F.col("permission")) >= LEVELS[need])
    rows = document_permissions.groupBy("doc_id").agg(F.collect_set(F.when(over, subject)).alias("_open"), F.collect_set(F.when(F.col("precedence") == "deny", subject)).alias("_shut"))
    scope, text = F.col("access_scope"), lambda c: F.col(c).cast("string")
    own = F.when(scope == "company", F.array(F.lit("company"))).when(scope == "department", F.array(F.concat(F.lit("d:"), F.coalesce(text("department_id"), F.lit(""))), F.lit("d:*"))).when(scope == "personal", F.array(F.concat(F.lit("u:"), F.coalesce(text("uploader_id"), F.lit("")))))
    none = F.array().cast("array<string>")
    found = documents.join(rows, "doc_id", "left")
    return found.select("doc_id", F.array_sort(F.array_union(F.coalesce(own, none), F.coalesce("_open", none))).alias("keys"), F.array_sort(F.coalesce("_shut", none)).alias("denied"))


def account_keys(accounts: DataFrame, account_roles: DataFrame) -> DataFrame:
    """``(account_id, keys)``: the keys that an account holds, for document_keys; a sorted array."""
    roles = account_roles.groupBy("account_id").agg(F.collect_set(F.concat(F.lit("r:"), F.col("role_id").cast("string"))).alias("_roles"))
    me, none = F.col("account_id").cast("string"), F.array().cast("array<string>")
    department = F.concat(F.lit("d:"), F.coalesce(F.col("department_id").cast("string"), F.lit("*")))
    own = F.array(F.lit("company"), department, F.concat(F.lit("u:"), me), F.concat(F.lit("a:"), me))
    return accounts.join(roles, "account_id", "left").select("account_id", F.array_sort(F.array_union(own, F.coalesce("_roles", none))).alias("keys"))


def dangling_subjects(permissions: DataFrame, accounts: DataFrame, roles: DataFrame) -> DataFrame:
    """Permission rows whose subject is in neither table, by type."""
    known = accounts.select(F.lit("account").alias("subject_type"), F.col("account_id").alias("subject_id")).unionByName(roles.select(F.lit("role").alias("subject_type"), F.col("role_id").alias("subject_id")))
    return permissions.join(known, ["subject_type", "subject_id"], "left_anti")


def named_subjects(permissions: DataFrame, accounts: DataFrame, roles: DataFrame) -> DataFrame:
    """Permission rows with ``subject_name``, the account's user name or the role's code (null if there is none)."""
    known = accounts.select(F.lit("account").alias("subject_type"), F.col("account_id").alias("subject_id"), F.col("username").alias("subject_name"))
    known = known.unionByName(roles.select(F.lit("role").alias("subject_type"), F.col("role_id").alias("subject_id"), F.col("code").alias("subject_name")))
    return permissions.join(known, ["subject_type", "subject_id"], "left")


def upload_scope(uploads: DataFrame, folders: DataFrame) -> DataFrame:
    """Uploads ``(upload_id, folder_id, department_id, access_scope)`` with their resolved department and scope.

    In a folder of a department both are the folder's; in another folder the
    scope is company without a department; without a folder the scope asked for
    holds, else department if one is given, else company.
    """
    f = folders.select(F.col("folder_id").alias("_f"), F.col("department_id").alias("_d"), F.col("access_scope").alias("_s"))
    rows = uploads.join(f, F.col("folder_id") == F.col("_f"), "left")
    inside = F.col("_f").isNotNull()
    department = F.when(inside, F.col("_d")).otherwise(F.col("department_id"))
    free = F.coalesce("access_scope", F.when(F.col("department_id").isNotNull(), "department").otherwise("company"))
    scope = F.when(inside & F.col("_d").isNotNull(), F.col("_s")).when(inside, "company").otherwise(free)
    return rows.select("upload_id", "folder_id", department.alias("department_id"), scope.alias("access_scope"))


def folder_checks(folders: DataFrame, grants: DataFrame, account, department, need: str) -> DataFrame:
    """``(folder_id, allowed)`` for one account: its own folders; else, within scope, a grant of the level, or any read."""
    ok = accessible_folders(folders, account, department).select("folder_id", F.lit(True).alias("_in"))
    own = grants.where(F.col("account_id") == account).select("folder_id", "folder_level")
    rows = folders.select("folder_id", "created_by").join(ok, "folder_id", "left").join(own, "folder_id", "left")
    granted = F.coalesce(F.col("folder_level") >= LEVELS[need], F.lit(False)) | F.lit(need == "read")
    return rows.select("folder_id", ((F.col("created_by") == account) | (F.coalesce("_in", F.lit(False)) & granted)).alias("allowed"))


def permission_cache(maxima: DataFrame, now: str, minutes: int = 60) -> DataFrame:
    """Cache rows of max_permission with their expiry."""
    return maxima.withColumn("expires_at", F.lit(now).cast("timestamp") + F.make_interval(mins=F.lit(minutes)))
