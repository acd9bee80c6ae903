"""JSON answers found in free text, and the records they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where an answer may sit, in the order they are tried.
PLACES = [
    r"(?s)^\s*(.*?)\s*$",
    r"(?s)<json_output>\s*(.*?)\s*</json_output>",
    r"(?s)<answer>\s*(.*?)\s*</answer>",
    r"(?s)```json\s*(.*?)\s*```",
    r"(?s)(\{.*\})",
]
CSV_BLOCK = r"(?s)<csv_output>\s*(.*?)\s*</csv_output>"


def find_json(text: Column) -> Column:
    """The first place whose content parses as JSON, as JSON text; NULL when none does."""
    tries = [F.regexp_extract(text, p, 1) for p in PLACES]
    return F.coalesce(*[F.when(t.rlike(r"^[\{\[]") & F.try_parse_json(t).isNotNull(), t) for t in tries])


def find_csv(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CSV_BLOCK, 1), F.lit(""))


def embedded_csv_lines(answers: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of the CSV block of each answer as ``(file, line_no, line)``."""
    block = answers.select(F.col(key).cast("string").alias("file"), find_csv(F.col(text)).alias("csv"))
    return block.filter(F.col("csv").isNotNull()).select("file", F.posexplode(F.split("csv", r"\r?\n", -1)).alias("line_no", "line"))


def table_kind(json: Column) -> Column:
    """Kind of table an annotation describes, by the keys it has."""
    keys = F.map_keys(F.when(json.rlike(r"^\s*\{"), F.from_json(json, "map<string,string>")))
    return (
        F.when(F.array_contains(keys, "raw_data_indices"), "data")
        .when(F.array_contains(keys, "raw_mapping_indices"), "map")
        .when(F.arrays_overlap(keys, F.array(F.lit("protocol_data"), F.lit("experimental_conditions"))), "protocol")
        .otherwise("unknown")
    )


LOG_ANSWER = (
    "files array<struct<file_name:string,file_type:string,timestamp_present:boolean,timestamp_column_index:int,"
    "variable_names_row_index:int,data_start_row_index:int,timestamp_source:string,confidence_score:double,"
    "imputed_timestamps:array<struct<row_index:int,timestamp:string>>>>"
)


def log_answers(answers: DataFrame, text: str) -> DataFrame:
    """One row per file of a log answer, with the source filled in and weak imputations marked."""
    rows = answers.select(F.explode(F.from_json(find_json(F.col(text)), LOG_ANSWER)["files"]).alias("a")).select("a.*")
    return fill_source(rows)


def fill_source(rows: DataFrame) -> DataFrame:
    has_imputed = F.coalesce(F.size("imputed_timestamps") > 0, F.lit(False))
    source = F.coalesce(
        F.col("timestamp_source"),
        F.when(F.coalesce("timestamp_present", F.lit(False)), "original").when(has_imputed, "imputed").otherwise("none"),
    )
    low = has_imputed & (F.coalesce("confidence_score", F.lit(0.0)) < 8)
    return rows.withColumn("timestamp_source", source).withColumn("low_confidence_imputation", low)
