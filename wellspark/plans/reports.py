"""Report queries over the usage entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspark.operators import reports as rp
from wellspark.plans.registry import query
from wellspark.plans.views import (
    EXPERIMENTS_AS_OF, USAGE_AS_OF, audit, experiments, limits, organizations, sessions, table, usage, users,
)

U, E = rp.AsOf.of(USAGE_AS_OF), rp.AsOf.of(EXPERIMENTS_AS_OF)
API, STORAGE = "click", "view"
SINCE = "\"timestamp\" >= TIMESTAMP '2024-01-01 00:00:00' AND \"timestamp\" < TIMESTAMP '2024-01-31 00:00:00'"
WEEK = "\"timestamp\" >= TIMESTAMP '2024-01-24 00:00:00' AND \"timestamp\" < TIMESTAMP '2024-01-31 00:00:00'"
BY_ORG = "organization_id, metric_type"


@query("agg_01_usage_summary", f"""
SELECT organization_id, metric_type, count(*) AS event_count, round(sum(metric_value), 2) AS total_value, round(avg(metric_value), 6) AS avg_value,
  max(metric_value) AS max_value, min("timestamp") AS first_event, max("timestamp") AS last_event FROM usage WHERE {SINCE} GROUP BY {BY_ORG}""")
def agg_01(spark, sf):
    return rp.usage_summary(usage(spark, sf), U)


@query("agg_02_daily_usage", f"""
SELECT organization_id, metric_type, "timestamp"::DATE AS usage_date, count(*) AS event_count, round(sum(metric_value), 2) AS total_value, count(DISTINCT user_id) AS unique_users
FROM usage WHERE {SINCE} GROUP BY ALL""")
def agg_02(spark, sf):
    return rp.daily_usage(usage(spark, sf), U)


@query("agg_03_user_usage", f"""
SELECT user_id, metric_type, count(*) AS event_count, round(sum(metric_value), 2) AS total_value, min("timestamp")::DATE AS first_activity, max("timestamp")::DATE AS last_activity
FROM usage WHERE {SINCE} GROUP BY user_id, metric_type""")
def agg_03(spark, sf):
    return rp.user_usage(usage(spark, sf), U)


@query("agg_04_top_users", f"""
SELECT t.*, email, username FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, metric_type ORDER BY total_value DESC, user_id) AS position FROM (
  SELECT organization_id, metric_type, user_id, count(*) AS event_count, round(sum(metric_value), 2) AS total_value, max("timestamp") AS last_activity
  FROM usage WHERE {SINCE} GROUP BY ALL)) t JOIN users ON users.id = t.user_id WHERE position <= 10""")
def agg_04(spark, sf):
    return rp.top_users(usage(spark, sf), users(spark, sf), U)


@query("agg_05_usage_trend", f"""
SELECT organization_id, metric_type, total_events, CASE WHEN total_events < 2 THEN 'stable' WHEN b > a THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
  round(CASE WHEN total_events >= 2 AND a > 0 THEN (b - a) / a * 100 ELSE 0 END, 2) AS trend_percentage
FROM (SELECT organization_id, metric_type, count(*) AS total_events, avg(CASE WHEN k <= n // 2 THEN v END) AS a, avg(CASE WHEN k > n // 2 THEN v END) AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY {BY_ORG} ORDER BY d) AS k, count(*) OVER (PARTITION BY {BY_ORG}) AS n FROM (
    SELECT organization_id, metric_type, "timestamp"::DATE AS d, sum(metric_value) AS v FROM usage WHERE {WEEK} GROUP BY ALL)) GROUP BY {BY_ORG})""")
def agg_05(spark, sf):
    return rp.usage_trend(usage(spark, sf), U)


@query("agg_06_hourly_pattern", f"""
SELECT organization_id, metric_type, extract(hour FROM "timestamp") AS hour, round(avg(metric_value), 6) AS avg_value FROM usage WHERE {WEEK} GROUP BY ALL""")
def agg_06(spark, sf):
    return rp.hourly_pattern(usage(spark, sf), U)


@query("agg_07_current_usage", """
SELECT organization_id, metric_type, round(sum(CASE WHEN "timestamp"::DATE = DATE '2024-01-20' THEN metric_value END), 2) AS today_total,
  round(sum(CASE WHEN "timestamp" < TIMESTAMP '2024-01-20 09:30:00' THEN metric_value END), 2) AS month_total
FROM usage WHERE "timestamp" >= TIMESTAMP '2024-01-01' AND "timestamp" < TIMESTAMP '2024-01-21' GROUP BY organization_id, metric_type""")
def agg_07(spark, sf):
    return rp.current_usage(usage(spark, sf), rp.AsOf.of("2024-01-20 09:30:00"))


CURRENT = """
SELECT o.id AS organization_id, coalesce(n, 0) AS experiments, coalesce(experiments_monthly, 100)::BIGINT AS experiments_limit, round(coalesce(api, 0), 2) AS api_calls,
  coalesce(api_calls_daily, 1000)::BIGINT AS api_calls_limit, round(coalesce(bytes, 0) / 1048576, 6) AS storage_mb, coalesce(l.storage_mb, 1024)::BIGINT AS storage_limit_mb
FROM organizations o LEFT JOIN limits l ON l.organization_id = o.id
LEFT JOIN (SELECT organization_id, count(*) AS n FROM experiments WHERE created_at >= TIMESTAMP '2001-07-01' AND created_at < TIMESTAMP '2001-07-20 10:00:00' GROUP BY 1) e ON e.organization_id = o.id
LEFT JOIN (SELECT organization_id, sum(CASE WHEN metric_type = 'click' AND "timestamp"::DATE = DATE '2024-01-20' THEN metric_value END) AS api,
  sum(CASE WHEN metric_type = 'view' AND "timestamp" < TIMESTAMP '2024-01-20 10:00:00' THEN metric_value END) AS bytes FROM usage GROUP BY 1) u ON u.organization_id = o.id"""


def current(spark, sf):
    at = rp.AsOf.of("2001-07-20 10:00:00")
    return rp.usage_against_limits(organizations(spark, sf), experiments(spark, sf), usage(spark, sf), limits(spark, sf), at, API, STORAGE, rp.AsOf.of("2024-01-20 10:00:00"))


@query("agg_08_usage_against_limits", CURRENT)
def agg_08(spark, sf):
    return current(spark, sf)


CHECKS = f"""
SELECT organization_id, measure, round(used, 6) AS used, cap AS limit_value, round(used / cap * 100, 4) AS percentage, used < cap AS allowed, used < cap AS within_limit, used / cap * 100 >= 80 AS warning,
  CASE WHEN used / cap * 100 >= 80 THEN 'You have used ' || round(used / cap * 100)::BIGINT || '% of your ' || what END AS message
FROM (SELECT organization_id, 'experiments' AS measure, experiments::DOUBLE AS used, experiments_limit::DOUBLE AS cap, 'monthly experiment limit' AS what FROM ({CURRENT})
  UNION ALL SELECT organization_id, 'api_calls', api_calls, api_calls_limit, 'daily API call limit' FROM ({CURRENT})
  UNION ALL SELECT organization_id, 'storage', storage_mb, storage_limit_mb, 'storage limit' FROM ({CURRENT}))"""


@query("agg_09_within_limits", f"SELECT organization_id, measure, used, limit_value, allowed, within_limit FROM ({CHECKS})")
def agg_09(spark, sf):
    return rp.limit_checks(current(spark, sf)).drop("percentage", "warning", "message")


@query("agg_10_limit_warnings", f"SELECT organization_id, measure, percentage, warning, message FROM ({CHECKS})")
def agg_10(spark, sf):
    return rp.limit_checks(current(spark, sf)).select("organization_id", "measure", "percentage", "warning", "message")


USER_COUNTS = """count(*) AS total_users, count(*) FILTER (is_active) AS active_users, count(*) FILTER (is_admin) AS admin_users,
  count(*) FILTER (is_system_admin) AS system_admin_users, count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' AND created_at < TIMESTAMP '2001-08-15') AS new_users_this_month"""


@query("agg_11_user_counts", f"SELECT organization_id, {USER_COUNTS} FROM users GROUP BY organization_id")
def agg_11(spark, sf):
    return rp.user_counts(users(spark, sf), E, ["organization_id"])


EXP_COUNTS = """count(*) AS total_experiments, count(*) FILTER (status = 'completed') AS completed_experiments, count(*) FILTER (status = 'processing') AS processing_experiments,
  count(*) FILTER (status = 'failed') AS failed_experiments"""


@query("agg_12_experiment_counts", f"""
SELECT organization_id, {EXP_COUNTS}, count(*) FILTER (created_at >= TIMESTAMP '2001-07-01' AND created_at < TIMESTAMP '2001-07-20 08:00:00') AS experiments_this_month, count(*) FILTER (created_at >= TIMESTAMP '2001-07-16' AND created_at < TIMESTAMP '2001-07-20 08:00:00') AS experiments_this_week,
  count(*) FILTER (created_at::DATE = DATE '2001-07-20') AS experiments_today, round(avg(epoch(completed_at - created_at)), 4) AS avg_processing_time_seconds,
  round(avg(epoch(completed_at - created_at)) / 60, 4) AS avg_processing_time_minutes FROM experiments GROUP BY organization_id""")
def agg_12(spark, sf):
    return rp.experiment_counts(experiments(spark, sf), rp.AsOf.of("2001-07-20 08:00:00"), ["organization_id"])


@query("agg_13_organization_rollup", """
SELECT o.id AS organization_id, name, o.created_at, o.is_active, coalesce(nu, 0) AS user_count, coalesce(na, 0) AS active_user_count, coalesce(nd, 0) AS admin_count, coalesce(ne, 0) AS experiment_count, last_user_activity
FROM organizations o LEFT JOIN (SELECT organization_id, count(*) AS nu, count(*) FILTER (is_active) AS na, count(*) FILTER (is_admin) AS nd, max(last_login) AS last_user_activity FROM users GROUP BY 1) u ON u.organization_id = o.id
LEFT JOIN (SELECT organization_id, count(*) AS ne FROM experiments GROUP BY 1) e ON e.organization_id = o.id""")
def agg_13(spark, sf):
    return rp.organization_rollup(organizations(spark, sf), users(spark, sf), experiments(spark, sf))


@query("join_05_rollup_reference_counts", """
SELECT o.id AS organization_id, name, o.created_at, o.is_active, sum(m)::BIGINT AS user_count, sum(CASE WHEN u.is_active THEN m ELSE 0 END)::BIGINT AS active_user_count,
  sum(CASE WHEN u.is_admin THEN m ELSE 0 END)::BIGINT AS admin_count, (any_value(coalesce(ne, 0)) * count(u.id))::BIGINT AS experiment_count, max(last_login) AS last_user_activity
FROM organizations o LEFT JOIN (SELECT organization_id, count(*) AS ne FROM experiments GROUP BY 1) e ON e.organization_id = o.id
LEFT JOIN (SELECT users.*, 1 AS one FROM users) u ON u.organization_id = o.id, LATERAL (SELECT greatest(coalesce(ne, 0), 1) AS m) GROUP BY o.id, name, o.created_at, o.is_active""")
def join_05(spark, sf):
    return rp.organization_rollup(organizations(spark, sf), users(spark, sf), experiments(spark, sf), semantics="reference")


@query("join_05b_user_reference_counts", f"""
SELECT u.id AS user_id, u.organization_id, email, username, count(e.id) AS experiment_count, count(*) FILTER (e.status = 'completed') AS completed_experiments, count(*) FILTER (e.status = 'failed') AS failed_experiments,
  count(*) FILTER (e.status = 'processing') AS processing_experiments, count(*) FILTER (e.created_at >= TIMESTAMP '2001-08-01' AND e.created_at < TIMESTAMP '2001-08-15') AS experiments_this_month, max(e.created_at) AS last_experiment_date,
  round(coalesce(sum(CASE WHEN metric_type = 'click' THEN metric_value END), 0), 2) AS api_calls, round(coalesce(sum(CASE WHEN metric_type = 'view' THEN metric_value END), 0), 2) AS storage_used,
  round(coalesce(sum(CASE WHEN metric_type = 'view' THEN metric_value END), 0) / 1048576, 6) AS storage_used_mb
FROM users u LEFT JOIN experiments e ON e.user_id = u.id LEFT JOIN usage t ON t.user_id = u.id GROUP BY u.id, u.organization_id, email, username""")
def join_05b(spark, sf):
    return rp.user_detail(users(spark, sf), experiments(spark, sf), usage(spark, sf), E, "reference", API, STORAGE)


@query("agg_14_system_statistics", """
SELECT 'users' AS section, name, value FROM (SELECT count(*)::DOUBLE AS total_users, count(*) FILTER (is_active)::DOUBLE AS active_users, count(*) FILTER (is_admin)::DOUBLE AS admin_users,
   count(*) FILTER (is_system_admin)::DOUBLE AS system_admin_users, count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' AND created_at < TIMESTAMP '2001-08-15')::DOUBLE AS new_users_this_month FROM users) UNPIVOT (value FOR name IN (*))
UNION ALL SELECT 'organizations', name, value FROM (SELECT count(*)::DOUBLE AS total_organizations, count(*) FILTER (is_active)::DOUBLE AS active_organizations,
   count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' AND created_at < TIMESTAMP '2001-08-15')::DOUBLE AS new_organizations_this_month FROM organizations) UNPIVOT (value FOR name IN (*))
UNION ALL SELECT 'experiments', name, value FROM (SELECT count(*)::DOUBLE AS total_experiments, count(*) FILTER (status = 'completed')::DOUBLE AS completed_experiments, count(*) FILTER (status = 'processing')::DOUBLE AS processing_experiments,
   count(*) FILTER (status = 'failed')::DOUBLE AS failed_experiments, count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' AND created_at < TIMESTAMP '2001-08-15')::DOUBLE AS experiments_this_month, count(*) FILTER (created_at::DATE = DATE '2001-08-15')::DOUBLE AS experiments_today FROM experiments) UNPIVOT (value FOR name IN (*))
UNION ALL SELECT 'usage_this_month', metric_type || '_total', round(sum(metric_value), 2) FROM usage WHERE "timestamp" >= TIMESTAMP '2024-01-01' AND "timestamp" < TIMESTAMP '2024-01-31' GROUP BY metric_type
UNION ALL SELECT 'usage_this_month', metric_type || '_events', count(*)::DOUBLE FROM usage WHERE "timestamp" >= TIMESTAMP '2024-01-01' AND "timestamp" < TIMESTAMP '2024-01-31' GROUP BY metric_type""")
def agg_14(spark, sf):
    return rp.system_statistics(users(spark, sf), organizations(spark, sf), experiments(spark, sf), usage(spark, sf), E, U)


DETAIL = """
SELECT u.id AS user_id, u.organization_id, email, username, coalesce(ne, 0) AS experiment_count, coalesce(nc, 0) AS completed_experiments, coalesce(nf, 0) AS failed_experiments,
  coalesce(np, 0) AS processing_experiments, coalesce(nm, 0) AS experiments_this_month, last_experiment_date,
  round(coalesce(api, 0), 2) AS api_calls, round(coalesce(bytes, 0), 2) AS storage_used, round(coalesce(bytes, 0) / 1048576, 6) AS storage_used_mb
FROM users u LEFT JOIN (SELECT user_id, count(*) AS ne, count(*) FILTER (status = 'completed') AS nc, count(*) FILTER (status = 'failed') AS nf, count(*) FILTER (status = 'processing') AS np,
    count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' AND created_at < TIMESTAMP '2001-08-15') AS nm, max(created_at) AS last_experiment_date FROM experiments GROUP BY 1) e ON e.user_id = u.id
LEFT JOIN (SELECT user_id, sum(CASE WHEN metric_type = 'click' THEN metric_value END) AS api, sum(CASE WHEN metric_type = 'view' THEN metric_value END) AS bytes FROM usage GROUP BY 1) t ON t.user_id = u.id"""


def detail(spark, sf):
    return rp.user_detail(users(spark, sf), experiments(spark, sf), usage(spark, sf), E, "counted", API, STORAGE)


@query("agg_15_user_detail", f"SELECT user_id, organization_id, email, username, experiment_count, completed_experiments, failed_experiments, last_experiment_date, api_calls, storage_used FROM ({DETAIL})")
def agg_15(spark, sf):
    return detail(spark, sf).select("user_id", "organization_id", "email", "username", "experiment_count", "completed_experiments", "failed_experiments", "last_experiment_date", "api_calls", "storage_used")


@query("agg_16_user_summary", f"SELECT user_id, processing_experiments, experiments_this_month, api_calls, storage_used_mb FROM ({DETAIL})")
def agg_16(spark, sf):
    return detail(spark, sf).select("user_id", "processing_experiments", "experiments_this_month", "api_calls", "storage_used_mb")


@query("agg_17_session_statistics", """
SELECT u.organization_id, count(*) AS total_sessions, count(*) FILTER (s.is_active AND expires_at > TIMESTAMP '2024-01-30 12:00:00') AS active_sessions,
  count(*) FILTER (s.created_at::DATE = DATE '2024-01-30') AS sessions_today, count(*) FILTER (s.created_at >= TIMESTAMP '2024-01-29' AND s.created_at < TIMESTAMP '2024-01-30 12:00:00') AS sessions_this_week,
  round(avg(epoch(last_activity - s.created_at)), 3) AS avg_session_duration_seconds, round(avg(epoch(last_activity - s.created_at)) / 60, 3) AS avg_session_duration_minutes
FROM sessions s JOIN users u ON u.id = s.user_id GROUP BY u.organization_id""")
def agg_17(spark, sf):
    return rp.session_statistics(sessions(spark, sf), users(spark, sf), rp.AsOf.of("2024-01-30 12:00:00"), ["organization_id"])


@query("agg_18_success_rate", f"SELECT user_id, {EXP_COUNTS}, round(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*), 4) AS success_rate FROM experiments GROUP BY user_id")
def agg_18(spark, sf):
    return rp.success_rates(experiments(spark, sf), ["user_id"])


@query("agg_19_daily_experiments", "SELECT created_at::DATE AS day, status, count(*) AS n FROM experiments GROUP BY ALL")
def agg_19(spark, sf):
    return experiments(spark, sf).groupBy(F.to_date("created_at").alias("day"), "status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_20_status_share", "SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM experiments), 4) AS percent FROM experiments GROUP BY status")
def agg_20(spark, sf):
    return rp.shares(experiments(spark, sf), "status")


@query("win_07_share_of_total", "SELECT metric_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM usage GROUP BY metric_type")
def win_07(spark, sf):
    return rp.shares(usage(spark, sf), "metric_type")


@query("agg_22_call_statistics", """
SELECT metric_type, count(*) AS total, count(*) FILTER (metric_value >= 5) AS succeeded, count(*) FILTER (metric_value < 5) AS failed, round(avg(metric_value), 6) AS mean_seconds FROM usage GROUP BY metric_type""")
def agg_22(spark, sf):
    calls = usage(spark, sf).select("metric_type", (F.col("metric_value") >= 5).alias("ok"), F.col("metric_value").alias("seconds"))
    return rp.call_statistics(calls, "metric_type")


@query("agg_23_record_count", "SELECT organization_id, count(*) AS n FROM experiments WHERE status = 'failed' AND created_at >= TIMESTAMP '2000-08-15' AND created_at < TIMESTAMP '2001-08-15' GROUP BY organization_id")
def agg_23(spark, sf):
    matching = experiments(spark, sf).filter((F.col("status") == "failed") & E.within("created_at", E.back(365)))
    return matching.groupBy("organization_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_26_rate_limits", f"""
SELECT user_id, metric_type, used, greatest(50 - used, 0) AS remaining, round(greatest(50 - used, 0) * 100.0::DOUBLE / 50, 4) AS remaining_pct, greatest(50 - used, 0) * 100.0 / 50 < 20 AS nearly_reached
FROM (SELECT user_id, metric_type, count(*) AS used FROM usage WHERE {SINCE} GROUP BY 1, 2)""")
def agg_26(spark, sf):
    return rp.remaining_requests(usage(spark, sf), U, 30, 50)


@query("agg_26b_violations", "SELECT attempt_type, user_org_id, count(*) AS n, count(DISTINCT user_id) AS n_users FROM audit WHERE NOT success GROUP BY ALL")
def agg_26b(spark, sf):
    return audit(spark, sf).filter(~F.col("success")).groupBy("attempt_type", "user_org_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users")
    )


@query("join_02_fact_dimension", "SELECT e.id, e.name, e.status, u.email AS user_email, u.username AS user_name FROM experiments e JOIN users u ON u.id = e.user_id")
def join_02(spark, sf):
    people = users(spark, sf).select(F.col("id").alias("user_id"), F.col("email").alias("user_email"), F.col("username").alias("user_name"))
    return experiments(spark, sf).join(people, "user_id").select("id", "name", "status", "user_email", "user_name")


@query("join_03_three_way", """
SELECT e.id, e.name, e.status, u.email AS user_email, o.name AS organization_name FROM experiments e JOIN users u ON u.id = e.user_id JOIN organizations o ON o.id = e.organization_id""")
def join_03(spark, sf):
    people = users(spark, sf).select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    orgs = organizations(spark, sf).select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    return experiments(spark, sf).join(people, "user_id").join(orgs, "organization_id").select("id", "name", "status", "user_email", "organization_name")


@query("join_04_left_aggregate", """
SELECT u.id AS user_id, email, username, full_name, count(e.id) AS experiment_count FROM users u LEFT JOIN experiments e ON e.user_id = u.id GROUP BY u.id, email, username, full_name""")
def join_04(spark, sf):
    counts = experiments(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    people = users(spark, sf).withColumnRenamed("id", "user_id")
    return people.join(counts, "user_id", "left").select("user_id", "email", "username", "full_name", F.coalesce("n", F.lit(0)).alias("experiment_count"))


@query("join_06_exists", "SELECT id, email FROM users WHERE EXISTS (SELECT 1 FROM usage WHERE usage.user_id = users.id AND metric_type = 'error')")
def join_06(spark, sf):
    errors = usage(spark, sf).filter(F.col("metric_type") == "error").select(F.col("user_id").alias("id"))
    return users(spark, sf).join(errors, "id", "left_semi").select("id", "email")


NEWEST = """SELECT id, user_id, metric_type, "timestamp", row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, id DESC) AS k FROM usage"""


@query("join_07_keep_newest", f'SELECT id, user_id, metric_type, "timestamp" FROM ({NEWEST}) WHERE k <= 5')
def join_07(spark, sf):
    return rp.newest(usage(spark, sf).select("id", "user_id", "metric_type", "timestamp"), "user_id", "timestamp", "id", 5)


@query("join_07b_deleted_rows", f'SELECT id, user_id FROM ({NEWEST}) WHERE k > 5')
def join_07b(spark, sf):
    """What the keep-newest rule deletes: everything that is not among the kept rows."""
    rows = usage(spark, sf).select("id", "user_id", "timestamp")
    kept = rp.newest(rows, "user_id", "timestamp", "id", 5)
    return rows.join(kept.select("id"), "id", "left_anti").select("id", "user_id")


@query("win_02_newest_per_key", """
SELECT id, user_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS k FROM experiments) WHERE k <= 3""")
def win_02(spark, sf):
    return rp.newest(experiments(spark, sf).select("id", "user_id", "status", "created_at"), "user_id", "created_at", "id", 3)


@query("join_08_calendar", """
SELECT d::DATE AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2001-07-17', TIMESTAMP '2001-08-15', INTERVAL 1 DAY)) AS d)
LEFT JOIN (SELECT created_at::DATE AS day, count(*) AS n FROM experiments WHERE created_at < TIMESTAMP '2001-08-15' GROUP BY 1) c ON c.day = d::DATE""")
def join_08(spark, sf):
    recent = experiments(spark, sf).filter(E.within("created_at", E.back(30)))
    return rp.calendar_counts(recent, F.to_date("created_at"), E)


@query("join_11_cross_tenant", "SELECT id, user_id, user_org_id, target_org_id, attempt_type, success FROM audit WHERE user_org_id <> target_org_id")
def join_11(spark, sf):
    return audit(spark, sf).filter(F.col("user_org_id") != F.col("target_org_id")).select("id", "user_id", "user_org_id", "target_org_id", "attempt_type", "success")


@query("join_13_default_limits", """
SELECT o.id AS organization_id, coalesce(experiments_monthly, 100)::BIGINT AS experiments_monthly, coalesce(api_calls_daily, 1000)::BIGINT AS api_calls_daily, coalesce(storage_mb, 1024)::BIGINT AS storage_mb
FROM organizations o LEFT JOIN limits l ON l.organization_id = o.id""")
def join_13(spark, sf):
    return rp.with_limits(organizations(spark, sf), limits(spark, sf))


@query("win_03_series_halves", f"""
SELECT organization_id, metric_type, d AS day, CASE WHEN k <= n // 2 THEN 1 ELSE 2 END::BIGINT AS half FROM (
  SELECT *, row_number() OVER (PARTITION BY {BY_ORG} ORDER BY d) AS k, count(*) OVER (PARTITION BY {BY_ORG}) AS n FROM (SELECT DISTINCT organization_id, metric_type, "timestamp"::DATE AS d FROM usage WHERE {SINCE}))""")
def win_03(spark, sf):
    from pyspark.sql import Window as W

    # One row per day and group, so a group holds at most as many rows as the period has days.
    days = usage(spark, sf).filter(U.within("timestamp", U.back(30))).select("organization_id", "metric_type", F.to_date("timestamp").alias("day")).distinct()
    g = W.partitionBy("organization_id", "metric_type")
    ranked = days.withColumn("k", F.row_number().over(g.orderBy("day"))).withColumn("n", F.count(F.lit(1)).over(g))
    return ranked.select("organization_id", "metric_type", "day", F.when(F.col("k") <= F.floor(F.col("n") / 2), 1).otherwise(2).alias("half"))


def logins(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type").isin("error", "signup"))
    return e.select("event_id", "ts", "user_id", (F.col("event_type") == "signup").alias("success"))


@query("win_06_failed_logins", """
SELECT event_id, ts, user_id, success, failed_attempts, (failed_attempts >= 5 AND NOT success) AS is_locked, CASE WHEN failed_attempts >= 5 AND NOT success THEN ts + INTERVAL 15 MINUTE END AS locked_until
FROM (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id)::BIGINT AS failed_attempts
  FROM (SELECT event_id, ts, user_id, event_type = 'signup' AS success, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
    FROM events WHERE event_type IN ('error', 'signup')))""")
def win_06(spark, sf):
    return rp.failed_login_locks(logins(spark, sf))
