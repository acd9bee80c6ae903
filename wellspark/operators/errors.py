"""Error classes, partial results and run reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from wellspark.operators.reports import error_totals

# Friendly texts of the error categories.
MESSAGES = {
    "file_io": "There was an issue reading the file. Please check that the file exists and is accessible.",
    "csv_parsing": "The CSV file could not be parsed. Please check the file format and try again.",
    "api_error": "There was an issue communicating with the AI service. Please try again later.",
    "data_processing": "An error occurred while processing your data. Some results may be incomplete.",
    "validation": "The input data did not meet the required format. Please check your data and try again.",
    "network": "A network error occurred. Please check your connection and try again.",
    "authentication": "Authentication failed. Please check your credentials.",
    "resource_limit": "Resource limits have been reached. Please try again later or contact support.",
    "unknown": "An unexpected error occurred. Please try again or contact support if the issue persists.",
}
FILE_ERRORS = r"no such file|permission denied|ioerror|oserror|filenotfounderror|is a directory"


def classify(message: Column, api_words: tuple[str, ...] = ("api",)) -> Column:
    """``STRUCT<category, severity>`` of an error text; callers may add the names of their services."""
    low = F.lower(message)
    category = (
        F.when(low.rlike(FILE_ERRORS), "file_io").when(low.rlike("csv|dataframe"), "csv_parsing").when(low.rlike("|".join(api_words)), "api_error")
        .when(low.rlike("timeout|connection"), "network").otherwise("unknown")
    )
    return F.struct(category.alias("category"), F.when(category == "csv_parsing", "medium").otherwise("high").alias("severity"))


def friendly(category: Column, file: Column | None = None) -> Column:
    texts = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    base = F.coalesce(F.try_element_at(texts, category), F.lit(MESSAGES["unknown"]))
    return base if file is None else F.when(file.isNotNull(), F.concat(base, F.lit(" File: "), F.substring_index(file, "/", -1))).otherwise(base)


def with_recovery(df: DataFrame, key: str, attempt: Column, message: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(successes with ``result``, failures as quarantine rows); ``strict`` stops the job at the first failure.

    ``attempt`` must give NULL where it fails, as the ``try_`` functions do.
    """
    if strict:
        return df.withColumn("result", F.coalesce(attempt, F.raise_error(message))), df.filter(F.lit(False))
    tried = df.withColumn("result", attempt)
    kind = classify(message)
    failed = tried.filter(F.col("result").isNull()).select(
        F.col(key).cast("string").alias("key"), kind["category"].alias("category"), kind["severity"].alias("severity"), message.alias("message"), F.lit(True).alias("recoverable")
    )
    return tried.filter(F.col("result").isNotNull()), failed


def fallback(operation: Callable[[], Column], value: object) -> Column:
    return F.coalesce(operation(), F.lit(value))


def run_report(errors: DataFrame, files_processed: int, output: str, seconds: float) -> DataFrame:
    """Error totals with the facts of the run on every line."""
    return error_totals(errors).select(
        "*", F.lit(files_processed).alias("files_processed"), F.lit(output).alias("output_file"), F.lit(seconds).alias("seconds"),
        F.when(F.col("n") > 0, "completed_with_errors").otherwise("success").alias("status"),
    )
