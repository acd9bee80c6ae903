"""Records that run over several lines, because a quoted cell holds line breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellspark.functions.ordered import CHUNK_ROWS, fill_forward, int_chunk, scan_two_states
from wellspark.operators.structure import DELIMITERS

#: Delimiters inside a character class.
_IN_CLASS = {"|": r"\|"}


def _whole(delimiter: str) -> str:
    """A line whose fields are all complete: a field that opens with a quote has its closing one; other quotes are text."""
    d = _IN_CLASS.get(delimiter, delimiter)
    rest = rf'(?:[^{d}"][^{d}]*+)?+'
    return rf'(?s)^(?:(?:"[^"]*+(?:""[^"]*+)*+"{rest}|{rest})(?:[{d}]|\z))*+\z'


def split_record(record: Column, delimiter: Column) -> Column:
    """Trimmed cells of a record: quoted ones without their quotes, doubled quotes as one; linear in the record's length."""
    out = F.array(record)
    for d in DELIMITERS:
        c = _IN_CLASS.get(d, d)
        fields = F.regexp_extract_all(F.concat(record, F.lit(d)), F.lit(rf'(?s)("[^"]*+(?:""[^"]*+)*+"[^{c}]*+|[^{c}]*+)[{c}]'), F.lit(1))
        plain = F.transform(fields, lambda x: F.when(x.rlike(r'(?s)^".*"\s*\z'), F.replace(F.regexp_replace(x, r'^"|"\s*\z', ""), F.lit('""'), F.lit('"'))).otherwise(x))
        out = F.when(delimiter == d, plain).otherwise(out)
    return F.transform(out, lambda x: F.trim(x))


def _ends_open(line: Column, delimiter: Column) -> Column:
    """Whether a line that begins outside quotes ends inside them."""
    out = F.lit(False)
    for d in DELIMITERS:
        out = F.when(delimiter == d, ~line.rlike(_whole(d))).otherwise(out)
    return out


def to_records(lines: DataFrame, delimiters: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(file, row, n_lines, record)``: the lines of ``lines`` joined into records, ``row`` being the first line's number.

    Only lines with a quote can open or close one.  Each is read for both
    starting states (outside and inside quotes), and the states are composed along
    the file chunk by chunk.  Lines between an opening and its closing line go
    together, blank ones too.  A file whose last quote is never closed is read
    line by line, as there every line would end in one cell.
    """
    lines = lines.select("file", F.col("line_no").cast("long").alias("line_no"), "line")
    quoted = lines.filter(F.contains("line", F.lit('"'))).join(delimiters.select("file", "delimiter"), "file")
    starts = quoted.select(
        "file", "line_no", _ends_open(F.col("line"), F.col("delimiter")).alias("from0"), _ends_open(F.concat(F.lit('"'), "line"), F.col("delimiter")).alias("from1")
    )
    read = scan_two_states(starts, ["file"], ["line_no"], int_chunk("line_no", chunk_rows), F.col("from0"), F.col("from1"), "quote").filter("quote_end = 0")
    turns = read.filter("quote_before <> quote_after").select("file", "line_no", "quote_after")
    closing = {"last": F.when(F.col("quote_after") == 0, F.col("line_no"))}
    spans = fill_forward(turns, ["file"], ["line_no"], int_chunk("line_no", chunk_rows), closing, backward=True).filter("quote_after = 1")
    members = spans.select("file", F.col("line_no").alias("row"), F.explode(F.sequence("line_no", "last")).alias("line_no"))
    placed = lines.join(members, ["file", "line_no"], "left")
    alone = placed.filter(F.col("row").isNull()).select("file", F.col("line_no").alias("row"), F.lit(1).cast("long").alias("n_lines"), F.col("line").alias("record"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    joined = placed.filter(F.col("row").isNotNull()).groupBy("file", "row").agg(F.count(F.lit(1)).alias("n_lines"), text.alias("record"))
    return alone.unionByName(joined)


def record_cells(records: DataFrame, delimiters: DataFrame) -> DataFrame:
    """``(file, row, col, cell)`` of records; a blank record gives no cells."""
    rows = records.filter(F.col("record").rlike(r"\S")).join(delimiters.select("file", "delimiter"), "file")
    return rows.select("file", F.col("row").cast("int").alias("row"), F.posexplode(split_record(F.col("record"), F.col("delimiter"))).alias("col", "cell"))
