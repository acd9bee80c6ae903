"""Usage, experiment, organisation, session and audit reports.

Each report covers all organisations or users in one pass; a caller narrows it
with a filter, which Catalyst pushes to the scan.  ``as_of`` replaces the wall
clock everywhere.  Counting happens before joining, so no report fans out.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Limits where an organisation has none, and the warning thresholds.
DEFAULT_LIMITS = {"experiments_monthly": 100, "api_calls_daily": 1000, "storage_mb": 1024}
WARN_PERCENT = 80
RATE_WARN_PERCENT = 20
MEGABYTE = 1024 * 1024
LOCK_AFTER = 5
LOCK_MINUTES = 15


@dataclass(frozen=True)
class AsOf:
    """Literal bounds relative to a moment, so that filters reach the scan."""

    at: datetime

    @staticmethod
    def of(text: str) -> "AsOf":
        return AsOf(datetime.fromisoformat(text))

    def _lit(self, t: datetime) -> Column:
        return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")

    @property
    def now(self) -> Column:
        return self._lit(self.at)

    @property
    def day(self) -> Column:
        return self._lit(self.at.replace(hour=0, minute=0, second=0, microsecond=0))

    @property
    def week(self) -> Column:
        day = self.at.replace(hour=0, minute=0, second=0, microsecond=0)
        return self._lit(day - timedelta(days=day.weekday()))

    @property
    def month(self) -> Column:
        return self._lit(self.at.replace(day=1, hour=0, minute=0, second=0, microsecond=0))

    def back(self, days: int) -> Column:
        return self._lit(self.at - timedelta(days=days))

    def within(self, time: Column | str, start: Column) -> Column:
        """From ``start`` up to this moment; what comes later has not happened yet."""
        time = F.col(time) if isinstance(time, str) else time
        return (time >= start) & (time < self.now)

    def today(self, time: Column | str) -> Column:
        """The whole day of this moment."""
        time = F.col(time) if isinstance(time, str) else time
        return (time >= self.day) & (time < self._lit(self.at.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)))


def _sum(c: str) -> Column:
    return F.round(F.sum(c), 2)


def usage_summary(usage: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    return usage.filter(as_of.within("timestamp", as_of.back(days))).groupBy("organization_id", "metric_type").agg(
        F.count(F.lit(1)).alias("event_count"), _sum("metric_value").alias("total_value"),
        F.round(F.avg("metric_value"), 6).alias("avg_value"), F.max("metric_value").alias("max_value"),
        F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"),
    )


def daily_usage(usage: DataFrame, as_of: AsOf, days: int = 30, exact: bool = True) -> DataFrame:
    """Per organisation, metric and day, with distinct users (optionally approximate)."""
    people = F.count_distinct("user_id") if exact else F.approx_count_distinct("user_id")
    return usage.filter(as_of.within("timestamp", as_of.back(days))).groupBy(
        "organization_id", "metric_type", F.to_date("timestamp").alias("usage_date")
    ).agg(F.count(F.lit(1)).alias("event_count"), _sum("metric_value").alias("total_value"), people.alias("unique_users"))


def user_usage(usage: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    return usage.filter(as_of.within("timestamp", as_of.back(days))).groupBy("user_id", "metric_type").agg(
        F.count(F.lit(1)).alias("event_count"), _sum("metric_value").alias("total_value"),
        F.to_date(F.min("timestamp")).alias("first_activity"), F.to_date(F.max("timestamp")).alias("last_activity"),
    )


def top_users(usage: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30, k: int = 10) -> DataFrame:
    """The ``k`` heaviest users of each organisation and metric.

    Aggregated before ranking; the rank filter is applied in each task before
    the ranking shuffle, so a large organisation does not move all its users.
    """
    totals = usage.filter(as_of.within("timestamp", as_of.back(days))).groupBy("organization_id", "metric_type", "user_id").agg(
        F.count(F.lit(1)).alias("event_count"), _sum("metric_value").alias("total_value"), F.max("timestamp").alias("last_activity")
    )
    rank = F.row_number().over(W.partitionBy("organization_id", "metric_type").orderBy(F.col("total_value").desc(), "user_id"))
    best = totals.withColumn("position", rank).filter(F.col("position") <= k)
    return best.join(users.select(F.col("id").alias("user_id"), "email", "username"), "user_id")


def usage_trend(usage: DataFrame, as_of: AsOf, days: int = 7) -> DataFrame:
    """Average daily total of the first and second half of the days, and the direction.

    The windows run over daily totals, at most ``days`` + 1 rows per group.
    """
    daily = usage.filter(as_of.within("timestamp", as_of.back(days))).groupBy(
        "organization_id", "metric_type", F.to_date("timestamp").alias("d")
    ).agg(F.sum("metric_value").alias("v"))
    group = W.partitionBy("organization_id", "metric_type")
    half = daily.withColumn("k", F.row_number().over(group.orderBy("d"))).withColumn("n", F.count(F.lit(1)).over(group))
    first = F.col("k") <= F.floor(F.col("n") / 2)
    avgs = half.groupBy("organization_id", "metric_type").agg(
        F.count(F.lit(1)).alias("total_events"), F.avg(F.when(first, F.col("v"))).alias("a"), F.avg(F.when(~first, F.col("v"))).alias("b")
    )
    enough = F.col("total_events") >= 2
    direction = F.when(~enough, "stable").when(F.col("b") > F.col("a"), "increasing").otherwise("decreasing")
    percent = F.when(enough & (F.col("a") > 0), (F.col("b") - F.col("a")) / F.col("a") * 100).otherwise(0.0)
    return avgs.select("organization_id", "metric_type", "total_events", direction.alias("trend_direction"), F.round(percent, 2).alias("trend_percentage"))


def hourly_pattern(usage: DataFrame, as_of: AsOf, days: int = 7) -> DataFrame:
    return usage.filter(as_of.within("timestamp", as_of.back(days))).groupBy(
        "organization_id", "metric_type", F.hour("timestamp").alias("hour")
    ).agg(F.round(F.avg("metric_value"), 6).alias("avg_value"))


def current_usage(usage: DataFrame, as_of: AsOf) -> DataFrame:
    """Totals of today and of the month to date in one pass."""
    today, month = as_of.today("timestamp"), as_of.within("timestamp", as_of.month)
    return usage.filter(today | month).groupBy("organization_id", "metric_type").agg(
        F.round(F.sum(F.when(today, F.col("metric_value"))), 2).alias("today_total"), F.round(F.sum(F.when(month, F.col("metric_value"))), 2).alias("month_total")
    )


def with_limits(orgs: DataFrame, limits: DataFrame) -> DataFrame:
    """Every organisation with its limits, or the defaults where it has none."""
    keyed = orgs.select(F.col("id").alias("organization_id")).join(limits, "organization_id", "left")
    return keyed.select("organization_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULT_LIMITS.items()])


def usage_against_limits(
    orgs: DataFrame, experiments: DataFrame, usage: DataFrame, limits: DataFrame, as_of: AsOf,
    api_metric: str = "api_call", storage_metric: str = "storage", usage_as_of: AsOf | None = None,
) -> DataFrame:
    """Use of this month, of today and of all storage so far; ``usage_as_of`` if usage has a moment of its own."""
    at = usage_as_of or as_of
    exps = experiments.filter(as_of.within("created_at", as_of.month)).groupBy("organization_id").agg(F.count(F.lit(1)).alias("experiments"))
    value, metric = F.col("metric_value"), F.col("metric_type")
    used = usage.filter(metric.isin(api_metric, storage_metric)).groupBy("organization_id").agg(
        F.sum(F.when((metric == api_metric) & at.today("timestamp"), value)).alias("api"),
        F.sum(F.when((metric == storage_metric) & (F.col("timestamp") < at.now), value)).alias("bytes"),
    )
    return (
        with_limits(orgs, limits).join(exps, "organization_id", "left").join(used, "organization_id", "left")
        .select(
            "organization_id", F.coalesce("experiments", F.lit(0)).alias("experiments"), F.col("experiments_monthly").alias("experiments_limit"),
            F.round(F.coalesce("api", F.lit(0.0)), 2).alias("api_calls"), F.col("api_calls_daily").alias("api_calls_limit"),
            F.round(F.coalesce("bytes", F.lit(0.0)) / MEGABYTE, 6).alias("storage_mb"), F.col("storage_mb").alias("storage_limit_mb"),
        )
    )


_MEASURES = [
    ("experiments", "experiments", "experiments_limit", "monthly experiment limit"),
    ("api_calls", "api_calls", "api_calls_limit", "daily API call limit"),
    ("storage", "storage_mb", "storage_limit_mb", "storage limit"),
]


def limit_checks(current: DataFrame, admin_override: bool = False) -> DataFrame:
    """One row per organisation and measure: used, limit, strictly within, warning at 80 %."""
    parts = [
        F.struct(F.lit(name).alias("measure"), F.col(used).cast("double").alias("used"), F.col(cap).cast("double").alias("cap"), F.lit(text).alias("what"))
        for name, used, cap, text in _MEASURES
    ]
    long = current.select("organization_id", F.inline(F.array(*parts)))
    pct = F.when(F.col("cap") > 0, F.col("used") / F.col("cap") * 100)
    within = F.col("used") < F.col("cap")
    warn = F.coalesce(pct >= WARN_PERCENT, F.lit(False))
    message = F.when(warn, F.concat(F.lit("You have used "), F.round(pct).cast("long").cast("string"), F.lit("% of your "), F.col("what")))
    return long.select(
        "organization_id", "measure", F.round("used", 6).alias("used"), F.col("cap").alias("limit_value"), F.round(pct, 4).alias("percentage"),
        (within | F.lit(admin_override)).alias("allowed"), within.alias("within_limit"), warn.alias("warning"), message.alias("message"),
    )


def _count_if(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def user_counts(users: DataFrame, as_of: AsOf, by: list[str]) -> DataFrame:
    return users.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_users"), _count_if(F.col("is_active"), "active_users"), _count_if(F.col("is_admin"), "admin_users"),
        _count_if(F.col("is_system_admin"), "system_admin_users"), _count_if(as_of.within("created_at", as_of.month), "new_users_this_month"),
    )


def _status(value: str) -> Column:
    return F.col("status") == value


def experiment_counts(experiments: DataFrame, as_of: AsOf, by: list[str]) -> DataFrame:
    """Counts by status and period with the mean run time."""
    seconds = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    at = F.col("created_at")
    out = experiments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_experiments"), _count_if(_status("completed"), "completed_experiments"),
        _count_if(_status("processing"), "processing_experiments"), _count_if(_status("failed"), "failed_experiments"),
        _count_if(as_of.within(at, as_of.month), "experiments_this_month"), _count_if(as_of.within(at, as_of.week), "experiments_this_week"),
        _count_if(as_of.today(at), "experiments_today"), (F.avg(seconds) / 1e6).alias("s"),
    )
    return out.withColumn("avg_processing_time_seconds", F.round("s", 4)).withColumn("avg_processing_time_minutes", F.round(F.col("s") / 60, 4)).drop("s")


def success_rates(experiments: DataFrame, by: list[str]) -> DataFrame:
    done = F.count_if(_status("completed"))
    return experiments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_experiments"), done.alias("completed_experiments"), _count_if(_status("failed"), "failed_experiments"),
        _count_if(_status("processing"), "processing_experiments"), F.round(done * 100.0 / F.count(F.lit(1)), 4).alias("success_rate"),
    )


def organization_rollup(orgs: DataFrame, users: DataFrame, experiments: DataFrame, semantics: str = "counted") -> DataFrame:
    """Users, active users, admins, experiments and last activity per organisation.

    ``semantics="reference"`` gives the numbers of a double outer join, in which
    every user is repeated per experiment; they follow from the two counts by
    multiplication, so the join itself never has to be formed.
    """
    u = users.groupBy("organization_id").agg(
        F.count(F.lit(1)).alias("nu"), F.count_if("is_active").alias("na"), F.count_if("is_admin").alias("nd"), F.max("last_login").alias("last_user_activity")
    )
    e = experiments.groupBy("organization_id").agg(F.count(F.lit(1)).alias("ne"))
    both = orgs.withColumnRenamed("id", "organization_id").join(u, "organization_id", "left").join(e, "organization_id", "left")
    nu, na, nd, ne = (F.coalesce(c, F.lit(0)) for c in ("nu", "na", "nd", "ne"))
    one = F.lit(1)
    per_user = F.greatest(ne, one) if semantics == "reference" else one
    per_exp = F.greatest(nu, one) if semantics == "reference" else one
    return both.select(
        "organization_id", "name", "created_at", "is_active", (nu * per_user).alias("user_count"), (na * per_user).alias("active_user_count"),
        (nd * per_user).alias("admin_count"), (ne * per_exp).alias("experiment_count"), "last_user_activity",
    )


def user_detail(
    users: DataFrame, experiments: DataFrame, usage: DataFrame, as_of: AsOf, semantics: str = "counted",
    api_metric: str = "api_call", storage_metric: str = "storage",
) -> DataFrame:
    """Experiments and usage per user, each side aggregated before the join."""
    e = experiments.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("ne"), F.count_if(_status("completed")).alias("nc"), F.count_if(_status("failed")).alias("nf"),
        F.count_if(_status("processing")).alias("np"), F.count_if(as_of.within("created_at", as_of.month)).alias("nm"), F.max("created_at").alias("last_experiment_date"),
    )
    value, metric = F.col("metric_value"), F.col("metric_type")
    # The multiplied form needs the count of all usage rows, the counted form only two metrics.
    used = usage if semantics == "reference" else usage.filter(metric.isin(api_metric, storage_metric))
    t = used.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("nt"), F.sum(F.when(metric == api_metric, value)).alias("api"), F.sum(F.when(metric == storage_metric, value)).alias("bytes")
    )
    both = users.withColumnRenamed("id", "user_id").join(e, "user_id", "left").join(t, "user_id", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("ne", "nc", "nf", "np", "nm", "nt")}
    one = F.lit(1)
    per_exp = F.greatest(n["nt"], one) if semantics == "reference" else one
    per_use = F.greatest(n["ne"], one) if semantics == "reference" else one
    size = F.coalesce("bytes", F.lit(0.0)) * per_use
    return both.select(
        "user_id", "organization_id", "email", "username", (n["ne"] * per_exp).alias("experiment_count"), (n["nc"] * per_exp).alias("completed_experiments"),
        (n["nf"] * per_exp).alias("failed_experiments"), (n["np"] * per_exp).alias("processing_experiments"), (n["nm"] * per_exp).alias("experiments_this_month"),
        "last_experiment_date", F.round(F.coalesce("api", F.lit(0.0)) * per_use, 2).alias("api_calls"), F.round(size, 2).alias("storage_used"),
        F.round(size / MEGABYTE, 6).alias("storage_used_mb"),
    )


def system_statistics(users: DataFrame, orgs: DataFrame, experiments: DataFrame, usage: DataFrame, as_of: AsOf, usage_as_of: AsOf) -> DataFrame:
    """System-wide numbers in long form: ``(section, name, value)``."""
    u = users.agg(
        F.count(F.lit(1)).alias("total_users"), _count_if(F.col("is_active"), "active_users"), _count_if(F.col("is_admin"), "admin_users"),
        _count_if(F.col("is_system_admin"), "system_admin_users"), _count_if(as_of.within("created_at", as_of.month), "new_users_this_month"),
    )
    o = orgs.agg(
        F.count(F.lit(1)).alias("total_organizations"), _count_if(F.col("is_active"), "active_organizations"),
        _count_if(as_of.within("created_at", as_of.month), "new_organizations_this_month"),
    )
    at = F.col("created_at")
    e = experiments.agg(
        F.count(F.lit(1)).alias("total_experiments"), _count_if(_status("completed"), "completed_experiments"), _count_if(_status("processing"), "processing_experiments"),
        _count_if(_status("failed"), "failed_experiments"), _count_if(as_of.within(at, as_of.month), "experiments_this_month"), _count_if(as_of.today(at), "experiments_today"),
    )

    def long(df: DataFrame, section: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns]
        return df.select(F.lit(section).alias("section"), F.inline(F.array(*pairs)))

    t = usage.filter(usage_as_of.within("timestamp", usage_as_of.month)).groupBy("metric_type").agg(_sum("metric_value").alias("total"), F.count(F.lit(1)).alias("n"))
    pairs = F.array(
        F.struct(F.concat("metric_type", F.lit("_total")).alias("name"), F.col("total").alias("value")),
        F.struct(F.concat("metric_type", F.lit("_events")).alias("name"), F.col("n").cast("double").alias("value")),
    )
    month = t.select(F.lit("usage_this_month").alias("section"), F.inline(pairs))
    return long(u, "users").unionByName(long(o, "organizations")).unionByName(long(e, "experiments")).unionByName(month)


def session_statistics(sessions: DataFrame, users: DataFrame, as_of: AsOf, by: list[str]) -> DataFrame:
    seconds = (F.unix_micros(F.col("last_activity").cast("timestamp")) - F.unix_micros(F.col("s_created").cast("timestamp"))) / 1e6
    owned = sessions.withColumnRenamed("created_at", "s_created").withColumnRenamed("is_active", "s_active").join(
        users.select(F.col("id").alias("user_id"), "organization_id"), "user_id"
    )
    out = owned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_sessions"), _count_if(F.col("s_active") & (F.col("expires_at") > as_of.now), "active_sessions"),
        _count_if(as_of.today("s_created"), "sessions_today"), _count_if(as_of.within("s_created", as_of.week), "sessions_this_week"), F.avg(seconds).alias("s"),
    )
    return out.withColumn("avg_session_duration_seconds", F.round("s", 3)).withColumn("avg_session_duration_minutes", F.round(F.col("s") / 60, 3)).drop("s")


def shares(df: DataFrame, by: str) -> DataFrame:
    """Rows and percent of all rows per value; the total is taken from the grouped counts."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).select("t").scalar()
    return counts.select(by, "n", F.round(F.col("n") * 100.0 / total, 4).alias("percent"))


def error_totals(errors: DataFrame) -> DataFrame:
    """Totals by category, by severity and overall, from one aggregate with grouping sets."""
    grouped = errors.groupingSets([["category"], ["severity"], []], "category", "severity")
    return grouped.agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_if("recoverable").alias("recoverable"), F.count_if(~F.col("recoverable")).alias("unrecoverable")
    ).select(
        F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "severity").otherwise("all").alias("level"),
        F.coalesce("category", "severity", F.lit("total")).alias("value"), "n", "recoverable", "unrecoverable",
    )


def call_statistics(calls: DataFrame, by: str) -> DataFrame:
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg("seconds"), 6).alias("mean_seconds")
    )


def remaining_requests(usage: DataFrame, as_of: AsOf, days: int, limit: int) -> DataFrame:
    """Share of a request limit left per user and metric, flagged when under 20 %."""
    used = usage.filter(as_of.within("timestamp", as_of.back(days))).groupBy("user_id", "metric_type").agg(F.count(F.lit(1)).alias("used"))
    left = F.greatest(F.lit(limit) - F.col("used"), F.lit(0))
    pct = left * 100.0 / limit
    return used.select("user_id", "metric_type", "used", left.alias("remaining"), F.round(pct, 4).alias("remaining_pct"), (pct < RATE_WARN_PERCENT).alias("nearly_reached"))


def calendar_counts(df: DataFrame, date: Column, as_of: AsOf, days: int = 30) -> DataFrame:
    """Rows per day for every one of the last days, 0 where none happened."""
    last = F.to_date(as_of.now)
    base = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last, F.expr("INTERVAL 1 DAY"))).alias("day"))
    counts = df.groupBy(date.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return base.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def newest(df: DataFrame, key: str, at: str, tie: str, k: int) -> DataFrame:
    """The newest ``k`` rows per key; the limit is applied per task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return df.withColumn("__k", rank).filter(F.col("__k") <= k).drop("__k")


def failed_login_locks(logins: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Failures since the last success, and until when the account is locked at five or more."""
    from wellspark.functions.ordered import count_since_reset, time_chunk

    counted = count_since_reset(
        logins, ["user_id"], [F.col("ts"), F.col("event_id")], time_chunk("ts", chunk_seconds), ~F.col("success"), F.col("success"), "failed_attempts"
    )
    locked = F.col("failed_attempts") >= LOCK_AFTER
    until = F.when(locked & ~F.col("success"), F.col("ts") + F.expr(f"INTERVAL {LOCK_MINUTES} MINUTE"))
    return counted.withColumn("is_locked", locked & ~F.col("success")).withColumn("locked_until", until)
