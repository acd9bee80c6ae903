"""Protocol conditions: JSON answers and scope tables turned into one row per well and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_MAP = "map<string,string>"
# A condition that is not an object is kept under this field name.
PLAIN_FIELD = "conditions"
PREFIX = "protocol_"
WELL_KEY = r"^[A-H].{0,2}$"
SHORT_WELL = r"^[A-H].{1,2}$"
PLATE_KEY = r"^(plate_|Plate_|PLATE_)"
MIN_WELLS_OF_PLATE = 10


def _object(text: Column) -> Column:
    """Members of a JSON object; nested values stay JSON text, so any depth fits one type."""
    return F.when(text.rlike(r"^\s*\{"), F.from_json(text, _MAP))


def _is_plate(entry: Column) -> Column:
    wells = F.filter(F.map_keys(_object(entry["value"])), lambda k: k.rlike(SHORT_WELL))
    short = entry["key"].rlike(r"^[A-Za-z0-9]{1,3}$") & (F.coalesce(F.size(wells), F.lit(0)) > MIN_WELLS_OF_PLATE)
    return entry["key"].rlike(PLATE_KEY) | short


def _pair(plate: Column, body: Column) -> Column:
    return F.struct(plate.alias("plate_id"), body.alias("body"))


def wells_from_json(answers: DataFrame, text: str = "json") -> DataFrame:
    """``(file, format, plate_id, well_id, field, value)`` of three accepted shapes.

    1: plates holding wells; 2: wells at the top; 3: ``metadata`` with ``wells``
    or ``experimental_conditions``.
    """
    doc = answers.withColumn("m", _object(F.col(text)))
    doc = doc.withColumn("plates", F.filter(F.map_entries("m"), _is_plate))
    keys = F.map_keys("m")
    known = F.array_contains(keys, "metadata") | F.array_contains(keys, "wells") | F.array_contains(keys, "experimental_conditions")
    shape = (
        F.when(F.size("plates") > 0, 1).when(F.forall(keys, lambda k: k.rlike(WELL_KEY)), 2).when(known, 3)
    )
    raw_id = F.try_element_at(_object(F.try_element_at("m", F.lit("metadata"))), F.lit("plate_id"))
    plate_id = F.coalesce(F.try_element_at(_object(raw_id), F.lit("value")), raw_id, F.lit("Unknown"))
    body = F.coalesce(F.try_element_at("m", F.lit("wells")), F.try_element_at("m", F.lit("experimental_conditions")))
    parts = (
        F.when(F.col("format") == 1, F.transform("plates", lambda e: _pair(F.regexp_replace(e["key"], PLATE_KEY, ""), e["value"])))
        .when(F.col("format") == 2, F.array(_pair(F.lit("Unknown"), F.col(text))))
        .when(F.col("format") == 3, F.array(_pair(plate_id, body)))
    )
    opened = doc.withColumn("format", shape).select("file", "format", F.inline(parts))
    wells = opened.select("file", "format", "plate_id", F.explode(_object(F.col("body"))).alias("well_id", "conditions"))
    wells = wells.filter((F.col("format") == 3) | F.col("well_id").rlike(WELL_KEY))
    fields = F.when(F.col("conditions").rlike(r"^\s*\{"), _object(F.col("conditions"))).otherwise(
        F.create_map(F.lit(PLAIN_FIELD), F.col("conditions"))
    )
    return wells.select("file", "format", "plate_id", "well_id", F.explode(fields).alias("field", "value")).withColumn(
        "field", F.concat(F.lit(PREFIX), F.col("field"))
    )


def expand_scopes(scopes: DataFrame) -> DataFrame:
    """Wells of each rectangular scope, generated from its own bounds without a join.

    A few bytes of a scope become many rows, so the scopes are dealt before they
    are opened: by a fixed number, as their size says nothing of what they open to.
    """
    parts = int(scopes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scopes.repartition(parts, F.xxhash64(*scopes.columns)).withColumn("r", F.explode(F.sequence("row_from", "row_to")))
    wells = rows.withColumn("c", F.explode(F.sequence("col_from", "col_to")))
    return wells.select(
        "plate_id", F.concat(F.char(F.lit(64) + F.col("r")), F.col("c").cast("string")).alias("well_id"),
        F.concat(F.lit(PREFIX), F.col("field")).alias("field"), "value",
    )


def field_names(long: DataFrame, limit: int = 2000) -> list[str]:
    """The distinct field names; more than ``limit`` is an error, never a cut."""
    names = [r[0] for r in long.select("field").distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} protocol fields; keep the long form")
    return sorted(names)


def widen(long: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One column per field, named in sorted order; wells of different files stay apart where ``file`` is known."""
    names = field_names(long) if fields is None else sorted(fields)
    keys = [c for c in ("file", "plate_id", "well_id") if c in long.columns]
    return long.groupBy(*keys).pivot("field", names).agg(F.max("value"))


def check_protocol(long: DataFrame, pattern: str = r"^[A-H][0-9]{1,2}$") -> DataFrame:
    """Per plate: wells, fields and bad well ids."""
    wells = long.groupBy("plate_id", "well_id").agg(F.count(F.lit(1)).alias("n_values"))
    per_plate = wells.groupBy("plate_id").agg(
        F.count(F.lit(1)).alias("n_wells"), F.sum("n_values").alias("n_values"),
        F.count_if(~F.col("well_id").rlike(pattern)).alias("n_bad"),
    )
    fields = long.groupBy("plate_id").agg(F.count_distinct("field").alias("n_fields"))
    return per_plate.join(fields, "plate_id").withColumn("is_valid", (F.col("n_bad") == 0) & (F.col("n_wells") > 0))
