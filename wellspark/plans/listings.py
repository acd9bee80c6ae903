"""Listings, filters, projections, set operations and table changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wellspark.operators import listings as ls, reports as rp, sinks
from wellspark.plans.registry import query
from wellspark.plans.reports import E, U
from wellspark.session import work_folder
from wellspark.plans.views import audit, experiments, limits, ntz, organizations, sessions, table, usage, users


@query("flt_01_optional_filters", "SELECT organization_id, status, count(*) AS n FROM experiments WHERE status = 'completed' GROUP BY ALL UNION ALL SELECT organization_id, status, count(*) FROM experiments WHERE status = 'failed' GROUP BY ALL")
def flt_01(spark, sf):
    e = experiments(spark, sf)
    parts = [ls.where_all(e, status=s, user_id=None).groupBy("organization_id", "status").agg(F.count(F.lit(1)).alias("n")) for s in ("completed", "failed")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("flt_02_last_days", """
SELECT days, id, metric_type FROM usage CROSS JOIN (VALUES (7::BIGINT, TIMESTAMP '2024-01-24'), (30, TIMESTAMP '2024-01-01'), (365, TIMESTAMP '2023-01-31')) AS p(days, since)
WHERE "timestamp" >= since AND "timestamp" < TIMESTAMP '2024-01-31'""")
def flt_02(spark, sf):
    periods = F.array_compact(F.array(*[F.when(U.within("timestamp", U.back(d)), F.lit(d)) for d in (7, 30, 365)]))
    return usage(spark, sf).select(F.explode(periods).alias("days"), "id", "metric_type")


@query("flt_03_valid_sessions", """
SELECT s.user_id, s.created_at, expires_at, email, u.organization_id FROM sessions s JOIN users u ON u.id = s.user_id WHERE s.is_active AND u.is_active AND expires_at > TIMESTAMP '2024-01-30 00:00:00'""")
def flt_03(spark, sf):
    return ls.valid_sessions(sessions(spark, sf), users(spark, sf), ntz("2024-01-30 00:00:00")).select("user_id", "created_at", "expires_at", "email", "organization_id")


@query("flt_04_search", "SELECT id, email, full_name, username FROM users WHERE contains(lower(email), '#00000001') OR contains(lower(full_name), '#00000001') OR contains(lower(username), '#00000001') OR contains(lower(username), 'r_9')")
def flt_04(spark, sf):
    u = users(spark, sf).select("id", "email", "full_name", "username")
    return ls.search_people(u, "#00000001").unionByName(ls.search_people(u, "R_9")).distinct()


@query("flt_05_status_filter", """
SELECT 'Active' AS status, id FROM users WHERE is_active UNION ALL SELECT 'Inactive', id FROM users WHERE NOT is_active UNION ALL SELECT 'Admin', id FROM users WHERE is_admin UNION ALL SELECT 'All', id FROM users""")
def flt_05(spark, sf):
    u = users(spark, sf)
    parts = [ls.filter_status(u, s).select(F.lit(s).alias("status"), "id") for s in ("All", "Active", "Inactive", "Admin")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("flt_06_metadata_type", "SELECT id, user_id, name FROM experiments WHERE json_extract_string(metadata, '$.analysis_type') = 'time_series'")
def flt_06(spark, sf):
    return experiments(spark, sf).filter(F.get_json_object("metadata", "$.analysis_type") == "time_series").select("id", "user_id", "name")


@query("flt_07_lookup", """
SELECT DISTINCT u.id, u.email, u.full_name, o.name AS organization_name FROM usage t JOIN users u ON u.id = t.user_id JOIN organizations o ON o.id = u.organization_id""")
def flt_07(spark, sf):
    """Look-up of many keys at once: the users that appear in the usage table, with their organisation's name."""
    keys = usage(spark, sf).select(F.col("user_id").alias("id")).distinct()
    orgs = organizations(spark, sf).select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    return users(spark, sf).join(keys, "id").join(orgs, "organization_id").select("id", "email", "full_name", "organization_name")


@query("flt_08_newest_of_organization", """
SELECT organization_id, id, user_email, created_at, position FROM (SELECT e.organization_id, e.id, u.email AS user_email, e.created_at, row_number() OVER (PARTITION BY e.organization_id ORDER BY e.created_at DESC, e.id DESC) AS position
  FROM experiments e JOIN users u ON u.id = e.user_id) WHERE position <= 10""")
def flt_08(spark, sf):
    """The ten newest experiments of every organisation, then the owner's e-mail."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("organization_id").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    top = experiments(spark, sf).select("organization_id", "id", "user_id", "created_at").withColumn("position", rank).filter(F.col("position") <= 10)
    people = users(spark, sf).select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    return top.join(people, "user_id").select("organization_id", "id", "user_email", "created_at", "position")


NEWEST = "SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY {at} DESC NULLS LAST, {tie} DESC) AS position FROM {source}"


@query("flt_08b_users_of_organization", f"SELECT organization_id, id, email, is_admin, is_active, created_at, last_login, position FROM ({NEWEST.format(scope='organization_id', at='created_at', tie='id', source='users')}) WHERE position <= 20")
def flt_08b(spark, sf):
    u = users(spark, sf).select("organization_id", "id", "email", "is_admin", "is_active", "created_at", "last_login")
    return ls.newest_of_scope(u, ["organization_id"], "created_at", "id", 20)


@query("flt_08c_all_users", """
SELECT u.id, u.email, o.name AS organization_name, u.is_system_admin, u.created_at FROM users u JOIN organizations o ON o.id = u.organization_id ORDER BY u.created_at DESC, u.id DESC LIMIT 50""")
def flt_08c(spark, sf):
    """The fifty newest users of all organisations; the names are looked up for those only."""
    top = ls.page(users(spark, sf).select("id", "email", "organization_id", "is_system_admin", "created_at"), [F.col("created_at").desc(), F.col("id").desc()], 50)
    orgs = organizations(spark, sf).select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    return top.join(orgs, "organization_id").select("id", "email", "organization_name", "is_system_admin", "created_at")


@query("flt_08d_experiments_of_user", f"SELECT user_id, id, name, status, created_at, position FROM ({NEWEST.format(scope='user_id', at='created_at', tie='id', source='experiments')}) WHERE position BETWEEN 3 AND 7")
def flt_08d(spark, sf):
    """The second page of every user's experiments."""
    e = experiments(spark, sf).select("user_id", "id", "name", "status", "created_at")
    return ls.newest_of_scope(e, ["user_id"], "created_at", "id", 5, 2)


@query("flt_08e_recent_experiments", """
SELECT e.id, e.name, e.status, e.created_at, u.email AS user_email, o.name AS organization_name FROM experiments e JOIN users u ON u.id = e.user_id JOIN organizations o ON o.id = e.organization_id
ORDER BY e.created_at DESC, e.id DESC LIMIT 25""")
def flt_08e(spark, sf):
    top = ls.page(experiments(spark, sf).select("id", "name", "status", "created_at", "user_id", "organization_id"), [F.col("created_at").desc(), F.col("id").desc()], 25)
    people = users(spark, sf).select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    orgs = organizations(spark, sf).select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    return top.join(people, "user_id").join(orgs, "organization_id").select("id", "name", "status", "created_at", "user_email", "organization_name")


@query("flt_08f_sessions_of_user", f"SELECT user_id, created_at, last_activity, is_active, position FROM ({NEWEST.format(scope='user_id', at='last_activity', tie='created_at', source='sessions')}) WHERE position <= 5")
def flt_08f(spark, sf):
    s = sessions(spark, sf).select("user_id", "created_at", "last_activity", "is_active")
    return ls.newest_of_scope(s, ["user_id"], "last_activity", "created_at", 5)


@query("flt_08g_files_of_experiment", """
SELECT experiment_id, file_no, uploaded_at, position FROM (SELECT l_orderkey AS experiment_id, l_linenumber::BIGINT AS file_no, l_shipdate AS uploaded_at,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS position FROM lineitem)""")
def flt_08g(spark, sf):
    """All files of every experiment, newest first; an experiment's files are few."""
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("experiment_id"), F.col("l_linenumber").alias("file_no"), F.col("l_shipdate").alias("uploaded_at"))
    return ls.newest_of_scope(files, ["experiment_id"], "uploaded_at", "file_no", 1000)


@query("flt_08h_admin_log", """
SELECT a.id, u.email AS admin_email, o.name AS target_name, a.action_type, a."timestamp" FROM audit a JOIN users u ON u.id = a.user_id LEFT JOIN organizations o ON o.id = a.target_org_id
WHERE a.action_type <> 'login' ORDER BY a."timestamp" DESC, a.id DESC LIMIT 100""")
def flt_08h(spark, sf):
    a = audit(spark, sf).filter(F.col("action_type") != "login").select("id", "user_id", "target_org_id", "action_type", "timestamp")
    top = ls.page(a, [F.col("timestamp").desc(), F.col("id").desc()], 100)
    people = users(spark, sf).select(F.col("id").alias("user_id"), F.col("email").alias("admin_email"))
    orgs = organizations(spark, sf).select(F.col("id").alias("target_org_id"), F.col("name").alias("target_name"))
    return top.join(people, "user_id").join(orgs, "target_org_id", "left").select("id", "admin_email", "target_name", "action_type", "timestamp")


@query("sort_01_descending", "SELECT id, email, created_at FROM users ORDER BY created_at DESC, id")
def sort_01(spark, sf):
    return users(spark, sf).select("id", "email", "created_at").orderBy(F.col("created_at").desc(), "id")


@query("sort_02_fallback_name", "SELECT id, coalesce(nullif(full_name, ''), nullif(username, ''), email) AS display_name, last_login FROM users ORDER BY display_name, last_login DESC NULLS LAST")
def sort_02(spark, sf):
    named = users(spark, sf).select("id", ls.display_name(F.col("full_name"), F.col("username"), F.col("email")).alias("display_name"), "last_login")
    return named.orderBy("display_name", F.col("last_login").desc_nulls_last())


@query("sort_03_top_k", "SELECT user_id, count(*) AS n FROM experiments GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def sort_03(spark, sf):
    return experiments(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "user_id").limit(10)


@query("sort_04_page", "SELECT id, user_id, status, created_at FROM experiments ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def sort_04(spark, sf):
    rows = experiments(spark, sf).select("id", "user_id", "status", "created_at")
    return ls.page(rows, [F.col("created_at").desc(), F.col("id")], 20, 40)


@query("sort_05_preview", "SELECT id, email FROM users ORDER BY id LIMIT 10")
def sort_05(spark, sf):
    return ls.page(users(spark, sf).select("id", "email"), [F.col("id")], 10)


@query("prj_01_rename_reorder", "SELECT \"timestamp\" AS happened_at, metric_type AS kind, metric_value AS amount, 'usage' AS category, id FROM usage")
def prj_01(spark, sf):
    u = usage(spark, sf).withColumnsRenamed({"timestamp": "happened_at", "metric_type": "kind", "metric_value": "amount"})
    return u.select("happened_at", "kind", "amount", F.lit("usage").alias("category"), "id")


@query("prj_03_history", """
SELECT id, name, status, created_at, json_extract_string(metadata, '$.analysis_type') AS analysis_type, json_extract_string(metadata, '$.files_processed')::BIGINT AS files_processed,
  json_extract_string(metadata, '$.summary.total_samples')::BIGINT AS total_samples FROM experiments""")
def prj_03(spark, sf):
    return ls.history(experiments(spark, sf))


@query("prj_04_display_name", "SELECT id, coalesce(nullif(full_name, ''), nullif(username, ''), email) AS display_name FROM users")
def prj_04(spark, sf):
    return users(spark, sf).select("id", ls.display_name(F.col("full_name"), F.col("username"), F.col("email")).alias("display_name"))


CODES = ["system_admin_granted", "organization_deactivated", "config_updated", "unlisted_action"]


@query("prj_05_action_text", """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'System admin privileges granted for u' || o_custkey WHEN 1 THEN 'Organization deactivated for ' || o_orderpriority
  WHEN 2 THEN 'System configuration updated - k' || o_custkey ELSE 'unlisted_action' END AS description FROM orders""")
def prj_05(spark, sf):
    k = F.col("o_orderkey") % 4
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (k + 1).cast("int"))
    who = F.col("o_custkey").cast("string")
    details = (
        F.when(k == 0, F.concat(F.lit('{"user_email": "u'), who, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"organization_name": "'), F.col("o_orderpriority"), F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"config_key": "k'), who, F.lit('"}'))).otherwise("{}")
    )
    log = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), code.alias("action_type"), details.alias("action_details"))
    return ls.describe_actions(log).select("id", "description")


@query("prj_06_days", "SELECT id, datediff('day', last_login::DATE, DATE '2001-08-15') AS days_since, datediff('day', DATE '2001-08-15', (created_at + INTERVAL 7 DAY)::DATE) AS days_left FROM users")
def prj_06(spark, sf):
    today = F.to_date(E.now)
    return users(spark, sf).select(
        "id", F.datediff(today, F.to_date("last_login")).alias("days_since"), F.datediff(F.date_add(F.to_date("created_at"), 7), today).alias("days_left")
    )


@query("prj_07_may_modify", """
SELECT p.id, actor_id, target_id, p.organization_id, CASE WHEN a.is_admin THEN 'admin' ELSE 'member' END AS actor_role,
  coalesce(a.organization_id = p.organization_id AND t.organization_id = p.organization_id AND (actor_id = target_id OR (a.is_admin AND a.is_active)), FALSE) AS may_modify
FROM (SELECT o_orderkey AS id, o_custkey AS actor_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END AS target_id, c_nationkey::BIGINT AS organization_id FROM orders JOIN customer ON c_custkey = o_custkey) p
LEFT JOIN users a ON a.id = actor_id LEFT JOIN users t ON t.id = target_id""")
def prj_07(spark, sf):
    k = F.col("id")
    pairs = audit(spark, sf).select("id", F.col("user_id").alias("actor_id"), F.when(k % 3 == 0, F.col("user_id")).otherwise(k).alias("target_id"), F.col("user_org_id").alias("organization_id"))
    return ls.may_modify(pairs, users(spark, sf))


@query("join_12_visible_counts", """
SELECT u.id AS user_id, is_admin, CASE WHEN is_admin THEN (coalesce(n_org, 0)) ELSE coalesce(n_own, 0) END AS visible FROM users u
LEFT JOIN (SELECT organization_id, count(*) AS n_org FROM experiments GROUP BY 1) o USING (organization_id) LEFT JOIN (SELECT user_id, count(*) AS n_own FROM experiments GROUP BY 1) w ON w.user_id = u.id""")
def join_12(spark, sf):
    return ls.visible_counts(experiments(spark, sf), users(spark, sf))


@query("join_12b_visible_to_newest_admin", """
SELECT e.id, e.user_id, e.organization_id FROM experiments e, (SELECT * FROM users WHERE is_admin ORDER BY created_at DESC, id DESC LIMIT 1) v WHERE e.organization_id = v.organization_id""")
def join_12b(spark, sf):
    viewer = users(spark, sf).filter("is_admin").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)
    return ls.visible_items(experiments(spark, sf).select("id", "user_id", "organization_id"), viewer)


@query("set_01_union_all", "SELECT id, status, 'completed' AS part FROM experiments WHERE status = 'completed' UNION ALL SELECT id, status, 'rest' FROM experiments WHERE status <> 'completed'")
def set_01(spark, sf):
    e = experiments(spark, sf).select("id", "status")
    done = e.filter(F.col("status") == "completed").withColumn("part", F.lit("completed"))
    return done.unionByName(e.filter(F.col("status") != "completed").withColumn("part", F.lit("rest")))


@query("set_02_union_by_name", "SELECT id, email, NULL AS status FROM users UNION ALL SELECT id, NULL, status FROM experiments")
def set_02(spark, sf):
    return users(spark, sf).select("id", "email").unionByName(experiments(spark, sf).select("id", "status"), allowMissingColumns=True)


@query("src_11_parameterised_sql", "SELECT u.organization_id, count(*) AS n FROM experiments e JOIN users u ON u.id = e.user_id WHERE e.status = 'completed' AND e.created_at >= TIMESTAMP '2000-08-15' GROUP BY u.organization_id")
def src_11(spark, sf):
    text = """SELECT u.organization_id, count(*) AS n FROM {experiments} e JOIN {users} u ON u.id = e.user_id
              WHERE e.status = :status AND e.created_at >= CAST(:since AS TIMESTAMP_NTZ) GROUP BY u.organization_id"""
    return spark.sql(text, args={"status": "completed", "since": "2000-08-15 00:00:00"}, experiments=experiments(spark, sf), users=users(spark, sf))


@query("snk_03_export_rows", """
SELECT organization_id, entity, count(*) AS n FROM (SELECT organization_id, 'users' AS entity FROM users UNION ALL SELECT organization_id, 'experiments' FROM experiments UNION ALL SELECT organization_id, 'usage' FROM usage) GROUP BY ALL""")
def snk_03(spark, sf):
    entities = {"users": users(spark, sf), "experiments": experiments(spark, sf), "usage": usage(spark, sf)}
    return sinks.export_counts(entities)


@query("snk_03b_export_json", """
SELECT organization_id, 'experiments' AS entity, '{"id":' || id || ',"organization_id":' || organization_id || ',"status":"' || status || '"}' AS record FROM experiments
UNION ALL SELECT organization_id, 'users', '{"id":' || id || ',"organization_id":' || organization_id || ',"email":"' || email || '"}' FROM users""")
def snk_03b(spark, sf):
    return sinks.export_rows({"experiments": experiments(spark, sf).select("id", "organization_id", "status"), "users": users(spark, sf).select("id", "organization_id", "email")})


@query("snk_03c_export_folders", """
SELECT organization_id, 'experiments' AS entity, '{"id":' || id || ',"organization_id":' || organization_id || ',"status":"' || status || '"}' AS record FROM experiments
UNION ALL SELECT organization_id, 'users', '{"id":' || id || ',"organization_id":' || organization_id || ',"email":"' || email || '"}' FROM users""")
def snk_03c(spark, sf):
    """The export written, a folder for each organisation and entity, and read back."""
    base = work_folder(spark, "export")
    sinks.export_folders({"experiments": experiments(spark, sf).select("id", "organization_id", "status"), "users": users(spark, sf).select("id", "organization_id", "email")}, base)
    return spark.read.text(base).select(F.col("organization_id").cast("long").alias("organization_id"), "entity", F.col("value").alias("record"))


@query("snk_05b_bucketed_upsert", """
SELECT id, email, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, new DESC, email DESC) AS k FROM (
  SELECT id, email, created_at AS updated_at, 0 AS new FROM users
  UNION ALL SELECT user_id, name || '@new', created_at, 1 FROM experiments WHERE user_id % 50 = 0
  UNION ALL SELECT user_id, status || '@newest', created_at, 2 FROM experiments WHERE user_id % 70 = 0)) WHERE k = 1""")
def snk_05b(spark, sf):
    """Users in buckets, two commits of updates, of which one comes twice."""
    from wellspark.operators.buckets import BucketedTable

    t = BucketedTable(spark, work_folder(spark, "bucketed"), ["id"], "updated_at", 16)
    t.create(users(spark, sf).select("id", "email", F.col("created_at").alias("updated_at")))
    e = experiments(spark, sf)
    first = e.filter("user_id % 50 = 0").select(F.col("user_id").alias("id"), F.concat("name", F.lit("@new")).alias("email"), F.col("created_at").alias("updated_at"))
    second = e.filter("user_id % 70 = 0").select(F.col("user_id").alias("id"), F.concat("status", F.lit("@newest")).alias("email"), F.col("created_at").alias("updated_at"))
    for name, updates in (("a", first), ("b", second), ("b", second)):
        t.upsert(updates, name)
    return t.read()


@query("snk_05_upsert", """
SELECT config_key, config_value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY config_key ORDER BY updated_at DESC, new DESC, config_value DESC) AS k FROM (
  SELECT n_name AS config_key, 'default' AS config_value, TIMESTAMP '1990-01-01' AS updated_at, 0 AS new FROM nation
  UNION ALL SELECT 'NATION_' || (o_orderkey % 40), 'v' || o_orderkey, o_orderdate + to_seconds(o_orderkey), 1 FROM orders)) WHERE k = 1""")
def snk_05(spark, sf):
    stored = table(spark, sf, "nation").select(F.col("n_name").alias("config_key"), F.lit("default").alias("config_value"), ntz("1990-01-01 00:00:00").alias("updated_at"))
    k = F.col("o_orderkey")
    updates = table(spark, sf, "orders").select(
        F.concat(F.lit("NATION_"), (k % 40).cast("string")).alias("config_key"), F.concat(F.lit("v"), k.cast("string")).alias("config_value"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k)).alias("updated_at"),
    )
    return sinks.upsert(stored, updates, ["config_key"], "updated_at")


@query("snk_06_retention", """
SELECT kept, count(*) AS n, round(sum(metric_value), 2) AS total FROM (SELECT metric_value, "timestamp" >= TIMESTAMP '2024-01-11' AS kept FROM usage) GROUP BY kept""")
def snk_06(spark, sf):
    kept, removed = sinks.retain(usage(spark, sf), "timestamp", U.back(20))
    both = kept.select("metric_value", F.lit(True).alias("kept")).unionByName(removed.select("metric_value", F.lit(False).alias("kept")))
    return both.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_value"), 2).alias("total"))


@query("snk_07_conditional_update", "SELECT u.id, u.email, coalesce(CASE WHEN NOT o.is_active THEN FALSE END, u.is_active) AS is_active, u.organization_id FROM users u JOIN organizations o ON o.id = u.organization_id")
def snk_07(spark, sf):
    """Users of deactivated organisations become inactive; all others stay as they are."""
    updates = organizations(spark, sf).filter("NOT is_active").select(F.col("id").alias("organization_id"), F.lit(False).alias("is_active"))
    return sinks.apply_updates(users(spark, sf).select("id", "email", "is_active", "organization_id"), updates, ["organization_id"])


@query("snk_08_delete_owned", "SELECT id, user_id FROM experiments WHERE NOT (status = 'failed' AND id % 2 = 0)")
def snk_08(spark, sf):
    e = experiments(spark, sf).select("id", "user_id", "status")
    # Every failed experiment is asked to be deleted; the odd ones by somebody else.
    asked = e.filter(F.col("status") == "failed").select("id", F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"))
    return sinks.delete_owned(e.select("id", "user_id"), asked, "id", "user_id")


@query("snk_09_unique_names", """
SELECT doc_id, lang, CASE WHEN k = 0 THEN name ELSE source || '_' || k || '.csv' END AS unique_name
FROM (SELECT *, source || '.csv' AS name, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS k FROM documents)""")
def snk_09(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", "lang", F.concat("source", F.lit(".csv")).alias("name"))
    return sinks.unique_names(files, "lang", "name", "doc_id").select("doc_id", "lang", "unique_name")


@query("snk_10_linked_rows", """
SELECT o_custkey AS admin_user_id, 'create_experiment' AS action_type, o_orderkey::VARCHAR AS target_id, '{"name":"Experiment ' || o_orderkey || '"}' AS action_details, TIMESTAMP '2001-08-15' AS "timestamp" FROM orders""")
def snk_10(spark, sf):
    rows = experiments(spark, sf).select("id", "user_id", "name")
    return sinks.audit_rows(rows, "create_experiment", E.now).drop("target_type")
