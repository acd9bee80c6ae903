"""User code hooks, each with a small example function."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import functions as F

from wellspark.functions import hooks
from wellspark.plans.registry import query
from wellspark.plans.views import log_lines, table


def _words(text: str) -> str:
    if text.startswith("E"):
        raise ValueError("no E")
    return str(text.count(" "))


@query("udf_01_item_function", "SELECT doc_id, CASE WHEN text LIKE 'E%' THEN NULL ELSE (length(text) - length(replace(text, ' ', '')))::VARCHAR END AS result, CASE WHEN text LIKE 'E%' THEN 'ValueError: no E' END AS error FROM documents")
def udf_01(spark, sf):
    done = table(spark, sf, "documents").select("doc_id", hooks.apply_items(_words, F.col("text")).alias("r"))
    return done.select("doc_id", "r.result", "r.error")


@query("udf_02_quoted_cells", "SELECT file, row, col, cell FROM log_cells")
def udf_02(spark, sf):
    """Only lines with a quote go to the CSV reader; the others are cut by a built-in."""
    lines = log_lines(spark, sf).filter(F.col("line").rlike(r"\S")).select("file", F.col("line_no").alias("row"), "line")
    has_quote = F.contains("line", F.lit('"'))
    quoted = lines.filter(has_quote).lateralJoin(hooks.QuotedCells(F.col("line").outer(), F.lit(","))).select("file", "row", "col", "cell")
    plain = lines.filter(~has_quote).select("file", "row", F.posexplode(F.split("line", ",")).alias("col", "cell"))
    return quoted.unionByName(plain.withColumn("cell", F.trim("cell")))


def _first_header(file: str, lines: Iterator[str]) -> str:
    row = next((i for i, line in enumerate(lines) if line and not line.startswith("#")), None)
    return json.dumps({"file_name": file, "variable_names_row_index": row})


@query("udf_03_annotator", "SELECT file, CASE WHEN min(CASE WHEN line_no = 0 THEN line END) LIKE '#%' THEN 1 ELSE 0 END::BIGINT AS header FROM log_lines GROUP BY file")
def udf_03(spark, sf):
    notes = hooks.annotate(log_lines(spark, sf), _first_header)
    return notes.select("file", F.get_json_object("json", "$.variable_names_row_index").cast("bigint").alias("header"))
