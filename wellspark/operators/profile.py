"""One-row-per-file profile that decides whether a log needs an annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wellspark.functions.values import contains_any, null_token, parse_time, to_num
from wellspark.operators.logs import time_step

# Name pieces, unit pieces and thresholds of the complexity tests.
TIME_LIKE = ["time", "timestamp", "datetime", "date"]
SUSPICIOUS = ["unnamed:", "column_", "field_", "var_", "x.", "x_"]
EPOCH_NAMES = ["epoch", "millis", "unix", "tick"]
TIME_PIECES = ["time", "date", "stamp"]
ZONES = ["-MST", "-PST", "-EST", "-GMT"]
SYMBOLS = ["°", "§", "µ", "±"]
UNITS = ["HPA", "L/MIN", "KG/M3"]
EPOCH_LOW, EPOCH_HIGH = 1e9, 9999999999999.0

FLAGS = [
    "many_time_columns", "duplicate_names", "comment_cells", "mostly_missing_column", "mixed_types", "suspicious_names", "very_wide",
    "transposed", "irregular_rows", "embedded_timestamps", "epoch_column", "odd_time_format", "non_ascii_names", "units_in_values",
]


def column_flags(cells: DataFrame) -> DataFrame:
    """Per column: fill, type and the value tests over all its known values, in one aggregate."""
    known, low = null_token("cell"), F.lower("name")
    looks_numeric = F.regexp_replace(known, "[.-]", "").rlike("^[0-9]+$")
    embedded = (F.contains(known, F.lit("T")) & F.contains(known, F.lit("Z"))) | (F.contains(known, F.lit("at 20")) & F.contains(known, F.lit(":")))
    odd = contains_any(known, ZONES) | ((F.length(known) > 10) & known.rlike("[0-9]") & parse_time(known).isNull())
    units = contains_any(known, SYMBOLS) | contains_any(F.upper(known), UNITS)
    stats = cells.groupBy("file", "col", "name").agg(
        F.count(known).alias("n_known"), F.count(to_num(known)).alias("n_numeric"), F.count(parse_time(known)).alias("n_parsed"), F.count_if(looks_numeric).alias("n_digits"),
        F.max(embedded).alias("embedded"), F.max(to_num(known).between(EPOCH_LOW, EPOCH_HIGH)).alias("epoch_values"), F.max(odd).alias("odd_values"), F.max(units).alias("unit_values"),
        F.max(F.trim("cell").startswith("#")).alias("comment"),
    )
    is_text = F.col("n_numeric") < F.col("n_known")
    false = F.lit(False)
    return stats.select(
        "file", "col", "name", "n_known", time_step(F.lower(F.trim("name")), F.col("col"), F.col("n_known"), F.col("n_parsed")).alias("step"), "comment",
        contains_any(low, TIME_LIKE).alias("time_like"), contains_any(low, SUSPICIOUS).alias("suspicious"), F.col("name").rlike(r"[^\x00-\x7F]").alias("non_ascii"),
        (is_text & (F.col("n_known") > 5) & (F.least(F.col("n_digits"), F.col("n_known") - F.col("n_digits")) >= 2)).alias("mixed"),
        F.coalesce(is_text & F.col("embedded"), false).alias("embedded"),
        (~is_text & (contains_any(low, EPOCH_NAMES) | F.coalesce("epoch_values", false))).alias("epoch"),
        F.coalesce(contains_any(low, TIME_PIECES) & F.col("odd_values"), false).alias("odd"), F.coalesce(is_text & F.col("unit_values"), false).alias("units"),
    )


def row_flags(cells: DataFrame) -> DataFrame:
    """Per file: number of rows, and the filled cells of the emptiest."""
    rows = cells.groupBy("file", "row").agg(F.count(null_token("cell")).alias("filled"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("filled").alias("least_filled"))


def profile_files(cells: DataFrame) -> DataFrame:
    """All flags of every file, ``needs_annotation`` and ``is_standard``."""
    time = F.when(F.col("step").isNotNull(), F.struct("step", "col", "name"))
    by_file = column_flags(cells).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_cols"), F.min("n_known").alias("least_known"), F.min(time).alias("time"),
        (F.count_if("time_like") > 1).alias("many_time_columns"), (F.size(F.collect_set("name")) < F.count(F.lit(1))).alias("duplicate_names"),
        F.max("mixed").alias("mixed_types"), (F.count_if("suspicious") > 2).alias("suspicious_names"), (F.count(F.lit(1)) > 100).alias("very_wide"),
        F.max("embedded").alias("embedded_timestamps"), F.max("epoch").alias("epoch_column"), F.max("odd").alias("odd_time_format"),
        F.max("non_ascii").alias("non_ascii_names"), F.max("units").alias("units_in_values"), F.max("comment").alias("comment_cells"),
    )
    both = by_file.join(row_flags(cells), "file").withColumn("mostly_missing_column", F.col("least_known") / F.col("n_rows") < 0.5)
    both = both.withColumn("transposed", (F.col("n_rows") <= 2) & (F.col("n_cols") > 10)).withColumn(
        "irregular_rows", (F.col("n_rows") > 5) & (F.col("least_filled") < F.col("n_cols") * 0.5)
    )
    needs = F.lit(False)
    for flag in FLAGS:
        needs = needs | F.coalesce(F.col(flag), F.lit(False))
    both = both.withColumn("needs_annotation", needs).withColumn("ts_col", F.col("time.col")).withColumn("ts_name", F.col("time.name"))
    standard = ~F.col("needs_annotation") & F.col("ts_col").isNotNull() & (F.col("n_cols") >= 2) & (F.col("n_rows") > 0)
    return both.select("file", "n_rows", "n_cols", *FLAGS, "needs_annotation", "ts_col", "ts_name", standard.alias("is_standard"))
