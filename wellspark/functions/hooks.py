"""Places where users plug in their own Python code."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import udtf


def apply_items(fn: Callable[[str], str | None], item: Column) -> Column:
    """``STRUCT<result, error>`` of a user function per item, in Arrow batches; an exception becomes the error text."""
    schema = T.StructType([T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(items: pd.Series) -> pd.DataFrame:
        def one(x: str | None) -> tuple[str | None, str | None]:
            try:
                return fn(x), None
            except Exception as e:  # any failure of user code belongs to its item
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(x) for x in items], columns=["result", "error"])

    return run(item)


@udtf(returnType=T.StructType([T.StructField("col", T.IntegerType()), T.StructField("cell", T.StringType())]), useArrow=True)
class QuotedCells:
    """Cells of one line by the rules of the standard CSV reader, for lines that carry quotes."""

    def eval(self, line: str, delimiter: str):
        if line is None:
            return
        for i, cell in enumerate(next(csv.reader([line], delimiter=delimiter))):
            yield i, cell.strip()


def annotate(lines: DataFrame, annotator: Callable[[str, Iterator[str]], str]) -> DataFrame:
    """Ask a user function for the annotation JSON of each file, given all its lines in order.

    Spark brings the lines of a file together and sorts them; the function gets
    an iterator and may stop where it knows enough, so no file is held whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(pdf["file"], pdf["line"]))
        for file, group in groupby(rows, key=lambda row: row[0]):
            yield pd.DataFrame({"file": [file], "json": [annotator(file, (line for _, line in group))]})

    return lines.select("file", "line_no", "line").repartition("file").sortWithinPartitions("file", "line_no").mapInPandas(run, "file string, json string")
