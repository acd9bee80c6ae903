"""Streaming queries, each run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspark.plans.registry import query, view
from wellspark.plans.reports import logins
from wellspark.plans.views import table, users
from wellspark.session import work_folder
from wellspark.streaming import events as ev, locks as lk, logfiles as lf


def complete(spark, sf, build, name):
    """A windowed stream run once over all events, the last windows included."""
    mark = ev.end_mark(spark, work_folder(spark, f"{name}-end"))
    return ev.run_available(build(ev.read_events(spark, sf), mark), name)


@query("str_01_daily_counters", f"""
SELECT window_start, organization_id, metric_type, count(*) AS event_count, round(sum(value), 2) AS total_value
FROM (SELECT date_trunc('day', ts) AS window_start, c_nationkey::BIGINT AS organization_id, event_type AS metric_type, value FROM events JOIN customer ON c_custkey = user_id)
GROUP BY window_start, organization_id, metric_type""")
def str_01(spark, sf):
    out = complete(spark, sf, lambda e, mark: ev.daily_counters(e, users(spark, sf), mark=mark), "daily-counters")
    return out.withColumn("total_value", F.round("total_value", 2))


@query("str_02_minute_budget", f"""
SELECT window_start, requests, tokens, requests > 50 OR tokens > 20000 AS over_budget FROM (SELECT date_trunc('minute', ts) AS window_start, count(*) AS requests, round(sum(value * 1000), 2) AS tokens FROM events GROUP BY 1)""")
def str_02(spark, sf):
    out = complete(spark, sf, lambda e, mark: ev.budget(e, F.col("value") * 1000, mark=mark), "budget")
    return out.withColumn("tokens", F.round("tokens", 2))


GATED = """
WITH RECURSIVE a AS (SELECT user_id, event_id, ts, event_type = 'signup' AS success, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('error', 'signup')),
walk AS (
  SELECT user_id, event_id, ts, success, k, FALSE AS ignored, CASE WHEN success THEN 0 ELSE 1 END AS failed, NULL::TIMESTAMP AS until FROM a WHERE k = 1
  UNION ALL
  SELECT a.user_id, a.event_id, a.ts, a.success, a.k, coalesce(a.ts < w.until, FALSE),
    CASE WHEN a.ts < w.until THEN w.failed WHEN a.success THEN 0 ELSE w.failed + 1 END,
    CASE WHEN a.ts < w.until THEN w.until WHEN NOT a.success AND w.failed + 1 >= 5 THEN a.ts + INTERVAL 15 MINUTE END
  FROM walk w JOIN a ON a.user_id = w.user_id AND a.k = w.k + 1)
SELECT user_id, event_id, ts, success, ignored, failed::BIGINT AS failed_attempts, until AS locked_until FROM walk"""


@query("str_03_gated_lock", GATED)
def str_03(spark, sf):
    e = ev.read_events(spark, sf).filter(F.col("event_type").isin("error", "signup"))
    attempts = e.select("user_id", "event_id", F.col("at").alias("ts"), (F.col("event_type") == "signup").alias("success"))
    return lk.gated_locks(attempts)


@query("str_03b_gated_lock_batch", GATED)
def str_03b(spark, sf):
    attempts = logins(spark, sf).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "success")
    return lk.gated_locks_batch(attempts)


@query("str_04_sessions", f"""
SELECT user_id, created_at AS session_start, last_activity + INTERVAL 30 MINUTE AS session_end, n_events FROM sessions""")
def str_04(spark, sf):
    return complete(spark, sf, lambda e, mark: ev.sessions(e, mark=mark), "sessions")


@query("str_04b_sessions_batch", "SELECT user_id, created_at, last_activity, n_events FROM sessions")
def str_04b(spark, sf):
    from wellspark.functions.ordered import sessionize

    return sessionize(table(spark, sf, "events"), ["user_id"], "ts", "event_id", 1800)


view("arriving", """
SELECT event_id, event_type, ts, user_id, printf('%.2f', value) AS v FROM events""")


@query("str_05_arriving_log_files", """
SELECT event_type, "column", count(*) AS n, count(DISTINCT "timestamp") AS n_times, round(sum(value::DOUBLE), 2) AS total FROM (
  SELECT event_type, ts AS "timestamp", 'value' AS "column", v AS value FROM arriving UNION ALL SELECT event_type, ts, 'user_id', user_id::VARCHAR FROM arriving) GROUP BY event_type, "column" """)
def str_05(spark, sf):
    """Daily log files are written, picked up as a stream and parsed into one table."""
    out = _arrived(spark, sf, broken=False)["rows"]
    kind = F.regexp_extract("source_file", "log=([a-z]+)_", 1)
    return out.groupBy(kind.alias("event_type"), "column").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("timestamp").alias("n_times"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total")
    )


@query("str_05b_nothing_is_lost", """
SELECT event_type, count(*) AS n_lines, count(*) FILTER (event_id % 17 <> 0) AS n_rows, count(*) FILTER (event_id % 17 = 0) AS n_quarantined, count(*) FILTER (event_id % 17 = 0) AS n_messages FROM events GROUP BY event_type""")
def str_05b(spark, sf):
    """Lines with unreadable times go to quarantine, and the ledger accounts for every line."""
    out = _arrived(spark, sf, broken=True)
    kind = lambda c: F.regexp_extract(c, "log=([a-z]+)_", 1).alias("event_type")
    lines = out["ledger"].groupBy(kind("file")).agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_rows", "n_quarantined")])
    return lines.join(out["quarantine"].groupBy(kind("source")).agg(F.count(F.lit(1)).alias("n_messages")), "event_type", "left")


def _arrived(spark, sf, broken):
    base = work_folder(spark, "arriving")
    e = table(spark, sf, "events")
    name = F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyyMMdd"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    stamp = F.when(F.col("event_id") % 17 == 0, "late").otherwise(stamp) if broken else stamp
    line = F.concat_ws(";", stamp, F.format_string("%.2f", "value"), F.col("user_id").cast("string"))
    body = e.select(name.alias("log"), F.col("event_id").alias("k"), line.alias("value"))
    head = e.select(name.alias("log")).distinct().select("log", F.inline(F.array(
        F.struct(F.lit(-2).cast("long").alias("k"), F.lit("# device log").alias("value")), F.struct(F.lit(-1).cast("long").alias("k"), F.lit("time;value;user_id").alias("value")),
    )))
    files = body.unionByName(head).repartition("log").sortWithinPartitions("log", "k").drop("k")
    files.write.partitionBy("log").text(f"{base}/in")
    return lf.run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")


@query("str_06_sliding_week", f"""
SELECT window_start, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) - to_days(i::INTEGER) AS window_start, event_type FROM events CROSS JOIN (SELECT unnest(range(7)) AS i))
GROUP BY ALL""")
def str_06(spark, sf):
    return complete(spark, sf, lambda e, mark: ev.sliding_activity(e, mark=mark), "sliding-week")
