"""File categories from names, content hints or an answer text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Hint words and category names.
LOG_NAME_HINTS = ["log", "sensor", "monitor", "equipment", "instrument", "event", "activity"]
LOG_CONTENT_HINTS = ["timestamp", "datetime", "time", "temperature", "pressure", "status", "event"]
DOCUMENT_ENDINGS = r"\.(txt|pdf|doc|docx|rtf)$"
CATEGORIES = ["data", "map", "protocol", "log", "other"]


def default_category(name: Column, content: Column) -> Column:
    log_name = F.lower(name).rlike("|".join(LOG_NAME_HINTS))
    log_text = F.coalesce(F.lower(content).rlike("|".join(LOG_CONTENT_HINTS)), F.lit(False))
    return (
        F.when(name.endswith(".csv"), F.when(log_name | log_text, "log").otherwise("data"))
        .when(name.rlike(DOCUMENT_ENDINGS), F.when(log_name, "log").otherwise("protocol"))
        .otherwise("other")
    )


def answered_category(files: DataFrame, answers: DataFrame, key: str, name: str = "name", text: str = "answer") -> DataFrame:
    """Category stated for a file in its answer text, else a default by ending.

    ``key`` joins each file to the one answer that covers it.
    """
    joined = files.join(answers, key, "left")
    # \Q…\E quotes the file name inside the pattern.
    quoted = F.concat(F.lit("\\Q"), F.col(name), F.lit("\\E"))
    shapes = [('"', r'"\s*:\s*"([^"]+)"'), ("'", r"'\s*:\s*'([^']+)'"), ("", r"\s*:\s*([a-zA-Z]+)"), ("", r"\s*->\s*([a-zA-Z]+)")]
    found = [
        F.lower(F.call_function("regexp_extract", F.col(text), F.concat(F.lit("(?i)" + q), quoted, F.lit(rest)), F.lit(1)))
        for q, rest in shapes
    ]
    stated = F.coalesce(*[F.when(f.isin(CATEGORIES), f) for f in found])
    fallback = F.when(F.col(name).endswith(".csv"), "data").when(F.col(name).rlike(r"\.(txt|pdf|doc|docx)$"), "protocol").otherwise("other")
    return joined.withColumn("category", F.coalesce(stated, fallback)).drop(text)
