"""Listings, searches, access rules and display columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Action codes and the text shown for them.
ACTION_TEXTS = {
    "system_admin_granted": "System admin privileges granted",
    "system_admin_revoked": "System admin privileges revoked",
    "organization_deactivated": "Organization deactivated",
    "organization_activated": "Organization activated",
    "user_deactivated": "User account deactivated",
    "user_activated": "User account activated",
    "config_updated": "System configuration updated",
    "system_admin_page_access": "System admin page accessed",
}


def where_all(df: DataFrame, **equals: object) -> DataFrame:
    """Keep rows equal to every argument that is not None."""
    conditions = [F.col(c) == v for c, v in equals.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def display_name(full_name: Column, username: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(full_name, F.lit("")), F.nullif(username, F.lit("")), email)


def search_people(users: DataFrame, text: str) -> DataFrame:
    """Case-insensitive search in e-mail, full name and user name; NULL names never match."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for c in ("email", "full_name", "username"):
        hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
    return users.filter(hit)


def filter_status(users: DataFrame, status: str) -> DataFrame:
    if status == "Active":
        return users.filter("is_active")
    if status == "Inactive":
        return users.filter("NOT is_active")
    if status == "Admin":
        return users.filter("is_admin")
    return users


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a sorted listing; ``order`` must end with a unique key."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def newest_of_scope(df: DataFrame, scope: list[str], at: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of every scope, newest first, with their ``position`` from 1; each task keeps as many before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*scope).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc()))
    top = df.withColumn("position", rank).filter(F.col("position") <= offset + limit)
    return top.filter(F.col("position") > offset) if offset else top


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Active, unexpired sessions of active users."""
    people = users.filter("is_active").select(F.col("id").alias("user_id"), "email", "organization_id")
    return sessions.filter(F.col("is_active") & (F.col("expires_at") > now)).join(people, "user_id")


def visible_items(items: DataFrame, viewer: DataFrame) -> DataFrame:
    """Items one viewer may see: an administrator those of the organisation, others their own.

    ``viewer`` is the one-row user record.
    """
    v = viewer.select(F.col("id").alias("v_id"), F.col("organization_id").alias("v_org"), F.col("is_admin").alias("v_admin")).limit(1)
    by_org = items.join(F.broadcast(v.filter("v_admin")), F.col("organization_id") == F.col("v_org")).select(*items.columns)
    own = items.join(F.broadcast(v.filter("NOT v_admin")), F.col("user_id") == F.col("v_id")).select(*items.columns)
    return by_org.unionByName(own)


def visible_counts(items: DataFrame, users: DataFrame) -> DataFrame:
    """How many items every user may see, from per-organisation and per-owner counts.

    Nothing pairs administrators with items: the counts are joined, not the rows.
    """
    per_owner = items.groupBy("user_id", "organization_id").agg(F.count(F.lit(1)).alias("n"))
    per_org = per_owner.groupBy("organization_id").agg(F.sum("n").alias("n_org"))
    own = per_owner.groupBy("user_id").agg(F.sum("n").alias("n_own"))
    return (
        users.select(F.col("id").alias("user_id"), "organization_id", "is_admin").join(per_org, "organization_id", "left").join(own, "user_id", "left")
        .select("user_id", "is_admin", F.coalesce(F.when(F.col("is_admin"), F.col("n_org")).otherwise(F.col("n_own")), F.lit(0)).alias("visible"))
    )


def may_modify(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """Role of the actor and whether the actor may change the target, per given pair and organisation."""
    a = users.select(F.col("id").alias("actor_id"), F.col("organization_id").alias("a_org"), F.col("is_admin").alias("a_admin"), F.col("is_active").alias("a_active"))
    t = users.select(F.col("id").alias("target_id"), F.col("organization_id").alias("t_org"))
    both = pairs.join(a, "actor_id", "left").join(t, "target_id", "left")
    same = (F.col("a_org") == F.col("organization_id")) & (F.col("t_org") == F.col("organization_id"))
    allowed = same & ((F.col("actor_id") == F.col("target_id")) | (F.col("a_admin") & F.col("a_active")))
    role = F.when(F.col("a_admin"), "admin").otherwise("member")
    return both.select(*pairs.columns, role.alias("actor_role"), F.coalesce(allowed, F.lit(False)).alias("may_modify"))


def describe_actions(log: DataFrame, details: str = "action_details") -> DataFrame:
    """Text of each action code, followed by its target out of the details JSON."""
    texts = F.create_map(*[F.lit(x) for kv in ACTION_TEXTS.items() for x in kv])
    base = F.coalesce(F.try_element_at(texts, F.col("action_type")), F.col("action_type"))
    field = lambda k: F.get_json_object(F.col(details), f"$.{k}")
    target = F.coalesce(
        F.concat(F.lit(" for "), field("user_email")), F.concat(F.lit(" for "), field("organization_name")),
        F.concat(F.lit(" - "), field("config_key")), F.lit(""),
    )
    return log.withColumn("description", F.concat(base, target))


def history(experiments: DataFrame) -> DataFrame:
    """Experiment history with fields read out of the metadata JSON."""
    m = F.from_json("metadata", "analysis_type string, files_processed bigint, summary struct<total_samples:bigint>")
    return experiments.withColumn("m", m).select(
        "id", "name", "status", "created_at", F.col("m.analysis_type").alias("analysis_type"),
        F.col("m.files_processed").alias("files_processed"), F.col("m.summary.total_samples").alias("total_samples"),
    )
