"""Writing results, and table changes expressed as new tables.

Spark's file tables have no row updates; every change is a query whose result
replaces the table.  ``replace_table`` writes beside the old data first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append usage events, laid out by day so that period filters prune folders."""
    events.withColumn("usage_date", F.to_date("timestamp")).write.mode("append").partitionBy("usage_date").parquet(path)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write a new version of a table; versions are folders, a reader takes the one returned."""
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def upsert(target: DataFrame, updates: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows by key, the latest one winning; an update wins a tie with the stored row.

    The latest row is an aggregate, so repeated updates of one hot key are
    combined in each task before they are shuffled.
    """
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    rest = [c for c in target.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(F.col(at), F.col("__new"))).alias("v")
    return both.groupBy(*key).agg(last).select(*key, *[F.col(f"v.`{c}`").alias(c) for c in rest])


def retain(df: DataFrame, at: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by age; both are filters of the same scan."""
    keep = F.coalesce(F.col(at) >= cutoff, F.lit(True))
    return df.filter(keep), df.filter(~keep)


def apply_updates(target: DataFrame, updates: DataFrame, key: list[str], at: str | None = None) -> DataFrame:
    """Non-NULL values of matching update rows replace those of the target.

    Of updates that repeat a key the one latest ``at`` counts, without it the
    largest, so no row of the target is multiplied.
    """
    changed = [c for c in updates.columns if c not in key and c != at]
    whole = F.struct(*[F.col(c).alias(f"__{c}") for c in changed])
    new = updates.groupBy(*key).agg((F.max_by(whole, at) if at else F.max(whole)).alias("_v")).select(*key, "_v.*")
    joined = target.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in target.columns])


def delete_owned(df: DataFrame, requests: DataFrame, key: str, owner: str) -> DataFrame:
    """Drop rows named in a request by their own owner; foreign requests change nothing."""
    return df.join(requests.select(key, owner).distinct(), [key, owner], "left_anti")


def unique_names(files: DataFrame, directory: str, name: str, tie: str) -> DataFrame:
    """Collision-free names: the first keeps its name, later ones get ``_1``, ``_2``, …

    Positions are counted chunk by chunk, so one very popular name is spread out.
    """
    from wellspark.functions.ordered import int_chunk, number_rows

    numbered = number_rows(files, [directory, name], [F.col(tie)], int_chunk(tie), "__k")
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    unique = F.when(F.col("__k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("__k").cast("string"), ext))
    return numbered.withColumn("unique_name", unique).drop("__k")


def export_rows(entities: dict[str, DataFrame], org: str = "organization_id") -> DataFrame:
    """All entities as ``(organization_id, entity, record)`` JSON rows.

    One row per record instead of one document per organisation: an
    organisation with a third of all data stays spread over many tasks and files.
    Write it with ``write_json(…, partition_by=[organization_id, entity])``.
    """
    parts = [
        df.select(F.col(org).alias("organization_id"), F.lit(name).alias("entity"), F.to_json(F.struct(*df.columns)).alias("record"))
        for name, df in entities.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def export_folders(entities: dict[str, DataFrame], path: str, org: str = "organization_id", parts: int = 8) -> None:
    """``export_rows`` as JSON lines, a folder for each organisation and entity.

    Records of one organisation are dealt over up to ``parts`` files, so that a large one is not written by a single task.
    """
    rows = export_rows(entities, org)
    spread = F.pmod(F.xxhash64("record"), F.lit(parts))
    rows.repartition("organization_id", "entity", spread).write.partitionBy("organization_id", "entity").text(path)


def export_counts(entities: dict[str, DataFrame], org: str = "organization_id") -> DataFrame:
    """Records per organisation and entity; needs no JSON, so columns are pruned."""
    parts = [df.groupBy(F.col(org).alias("organization_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("entity", F.lit(name)) for name, df in entities.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def new_experiments(requests: DataFrame, at: Column) -> DataFrame:
    """Experiment rows with defaults, one per request."""
    return requests.select(
        F.uuid().alias("id"), "user_id", "organization_id", "name", F.lit("pending").alias("status"), at.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at")
    )


def audit_rows(rows: DataFrame, action: str, at: Column) -> DataFrame:
    """Audit entries derived from new or changed rows."""
    return rows.select(
        F.col("user_id").alias("admin_user_id"), F.lit(action).alias("action_type"), F.lit("experiment").alias("target_type"),
        F.col("id").cast("string").alias("target_id"), F.to_json(F.struct("name")).alias("action_details"), at.alias("timestamp"),
    )


def append_linked(spark: SparkSession, requests: DataFrame, at: Column, experiments_path: str, audit_path: str) -> None:
    """Append experiments and their audit entries.

    Ids are random, so the experiments are written once and the audit entries
    are derived from what was written: a retried task cannot give them other ids.
    """
    from wellspark.session import work_folder

    stage = work_folder(spark, "new-experiments")
    staged = replace_table(new_experiments(requests, at), stage)
    staged.write.mode("append").parquet(experiments_path)
    audit_rows(staged, "create_experiment", at).write.mode("append").parquet(audit_path)
