"""Delimiter, header and data-block detection over ``(file, line_no, line)``.

Every function looks at many files at once and at all their lines.  What is known
of a file comes from histograms and minima that each task sums up before the
shuffle, so a long file moves no more rows than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellspark.functions.values import count_of, is_num
from wellspark.session import settle

# Candidate delimiters in tie order, and words that end a data block.
DELIMITERS = [",", ";", "\t", "|"]
UNIFORM_DELIMITERS = ["\t", ",", ";", "|", "  "]
STOP_WORDS = ["total", "summary", "notes", "comments", "analysis"]
PLATE_COLUMNS = 12

HEADER_WORDS = ["time", "event", "column", "header", "name"]

_LITERAL = {",": ",", ";": ";", "\t": "\t", "|": r"\|", "  ": "  "}


def strip_bom(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", "^﻿", ""))


def fix_decimal_commas(lines: DataFrame) -> DataFrame:
    """Decimal commas become points where semicolons outnumber commas."""
    line = F.col("line")
    fixed = F.regexp_replace(line, r"\b([0-9]+),([0-9]+)\b", "$1.$2")
    commas = count_of(line, ",")
    return lines.withColumn("line", F.when((commas > 0) & (count_of(line, ";") > commas), fixed).otherwise(line))


def width(line: Column, delimiter: str) -> Column:
    """Number of fields when a line is cut at a literal delimiter."""
    pieces = count_of(line, delimiter)
    return (pieces if len(delimiter) == 1 else F.floor(pieces / len(delimiter))).cast("int") + 1


def width_by(line: Column, delimiter: Column) -> Column:
    """Same with the delimiter taken from a column."""
    out = F.lit(1)
    for d in DELIMITERS:
        out = F.when(delimiter == d, width(line, d)).otherwise(out)
    return out


def not_blank(line: Column | str = "line") -> Column:
    line = F.col(line) if isinstance(line, str) else line
    return line.rlike(r"\S")


def _candidates(lines: DataFrame, delimiters: list[str]) -> DataFrame:
    options = [
        F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), width(F.col("line"), d).alias("n_cols"))
        for i, d in enumerate(delimiters)
    ]
    return lines.select("file", "line_no", F.inline(F.array(*options)))


def _score(mode: Column, ratio: Column, semicolon: Column, fixed: bool) -> Column:
    points = (
        ratio * 100
        + F.when(mode.isin(8, 12, 96), 50).when(mode > 4, 10).otherwise(0)
        - F.when(mode < 2, 50).when(mode > 50, 20).otherwise(0)
        + F.when(semicolon & (ratio > 0.8), 20).otherwise(0)
    ).cast("double")
    return F.when(mode < 2, F.lit(0.0)).otherwise(points) if fixed else points


def width_modes(lines: DataFrame, sample: int | None = None) -> DataFrame:
    """``(file, rank, delimiter, mode, ratio)``: the commonest width by each candidate and its share of the non-blank lines.

    All lines count, unless the first ``sample`` are asked for.  The smaller
    width wins a tie.  A file without such lines has NULL for both.
    """
    some = not_blank() if sample is None else not_blank() & (F.col("line_no") < sample)
    widths = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), F.when(some, width(F.col("line"), d)).alias("n_cols")) for i, d in enumerate(DELIMITERS)])
    each = lines.select("file", F.inline(widths))
    counted = each.groupBy("file", "rank", "delimiter", "n_cols").agg(F.count(F.col("n_cols")).alias("n"))
    top = F.max_by("n_cols", F.when(F.col("n_cols").isNotNull(), F.struct(F.col("n"), -F.col("n_cols"))))
    return counted.groupBy("file", "rank", "delimiter").agg(top.alias("mode"), F.max("n").alias("most"), F.sum("n").alias("total")).select(
        "file", "rank", "delimiter", "mode", (F.col("most") / F.nullif("total", F.lit(0))).alias("ratio")
    )


def detect_delimiter(lines: DataFrame, sample: int | None = None, fixed: bool = True) -> DataFrame:
    """``(file, delimiter, score)`` for every file; the earlier candidate wins a tie, a blank file has a comma and no score.

    ``fixed`` scores a candidate that never occurs as 0 instead of letting the
    uniform width of 1 count as consistency.
    """
    score = _score(F.col("mode"), F.col("ratio"), F.col("delimiter") == ";", fixed)
    best = width_modes(lines, sample).withColumn("score", F.when(F.col("mode").isNotNull(), score)).groupBy("file").agg(
        F.max_by(F.struct("delimiter", "score"), F.struct(F.col("score"), -F.col("rank"))).alias("top")
    )
    return best.select("file", "top.delimiter", "top.score")


def detect_delimiter_by_count(lines: DataFrame) -> DataFrame:
    """Semicolon when it outnumbers commas over all lines, else the most frequent candidate."""
    head = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    c, s, t, p = (F.sum(count_of("line", d)) for d in DELIMITERS)
    counts = head.groupBy("file").agg(c.alias("c"), s.alias("s"), t.alias("t"), p.alias("p"))
    top = F.greatest("c", "s", "t", "p")
    choice = (
        F.when((F.col("c") > 0) & (F.col("s") > F.col("c")), ";")
        .when(F.col("c") == top, ",")
        .when(F.col("s") == top, ";")
        .when(F.col("t") == top, "\t")
        .otherwise("|")
    )
    return counts.select("file", choice.alias("delimiter"))


def detect_uniform_delimiter(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Delimiter with one and the same, largest width on all lines of the data block; NULL for a file without one."""
    inside = (F.col("line_no") >= F.col("data_start")) & (F.col("line_no") < F.col("data_end")) & not_blank()
    rows = lines.join(blocks, "file").filter(inside)
    spread = _candidates(rows, UNIFORM_DELIMITERS).groupBy("file", "rank", "delimiter").agg(F.min("n_cols").alias("low"), F.max("n_cols").alias("high"))
    uniform = spread.filter((F.col("low") == F.col("high")) & (F.col("low") > 1))
    found = uniform.groupBy("file").agg(F.max_by("delimiter", F.struct(F.col("low"), -F.col("rank"))).alias("delimiter"), F.max("low").cast("int").alias("n_cols"))
    return blocks.select("file").join(found, "file", "left")


def header_rows(lines: DataFrame) -> DataFrame:
    """First line with more than four tokens of which over half are numbers, else 1."""
    parts = F.filter(F.split(F.replace(F.col("line"), F.lit(","), F.lit(".")), r"\s+"), lambda x: x != "")
    numeric = F.size(F.filter(parts, is_num))
    hit = (F.size(parts) > 4) & (numeric > F.size(parts) * 0.5)
    return lines.groupBy("file").agg(
        F.coalesce(F.min(F.when(hit & not_blank(), F.col("line_no"))), F.lit(1)).cast("int").alias("header_rows")
    )


def plate_label_row(lines: DataFrame) -> DataFrame:
    """First line that mentions both ``plate`` and ``id``."""
    low = F.lower("line")
    hit = F.contains(low, F.lit("plate")) & F.contains(low, F.lit("id"))
    return (
        lines.groupBy("file")
        .agg(F.min(F.when(hit, F.col("line_no"))).cast("int").alias("plate_id_row"))
        .withColumn("has_plate_id", F.col("plate_id_row").isNotNull())
    )


def column_pattern(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """``(file, line_no, n_cols)`` of every non-blank line."""
    known = lines.filter(not_blank()).join(delimiters.select("file", "delimiter"), "file")
    return known.select("file", "line_no", width_by(F.col("line"), F.col("delimiter")).alias("n_cols"))


def data_start(lines: DataFrame, delimiters: DataFrame, headers: DataFrame) -> DataFrame:
    """First line with exactly twelve fields, over 70 % of them numbers; else the header row count."""
    rows = lines.join(delimiters.select("file", "delimiter"), "file")
    wide = (width_by(F.col("line"), F.col("delimiter")) == PLATE_COLUMNS) & not_blank()
    numeric = F.size(F.filter(plain_split(F.col("line"), F.col("delimiter")), is_num))
    # The cheap width test runs before any line is split.
    hit = F.when(wide, numeric > PLATE_COLUMNS * 0.7).otherwise(F.lit(False))
    first = rows.groupBy("file").agg(F.min(F.when(hit, F.col("line_no"))).alias("found"))
    return first.join(headers, "file", "left").select(
        "file", F.coalesce("found", "header_rows", F.lit(1)).cast("int").alias("data_start")
    )


def data_block(lines: DataFrame, delimiters: DataFrame, starts: DataFrame) -> DataFrame:
    """``(file, data_start, data_end)``; the end is exclusive: the first line after the start that ends the data.

    A line ends it if it is blank, holds a stop word or is under half as wide as
    most lines from the start on.  The lines are summed up by (file, width) with
    the first line of each width, so that the widths too small for the file's
    mode can be told afterwards without reading the lines again.
    """
    bounds = delimiters.select("file", "delimiter").join(starts, "file")
    rows = lines.join(bounds, "file").filter(F.col("line_no") >= F.col("data_start"))
    low = F.lower("line")
    stop = ~not_blank()
    for word in STOP_WORDS:
        stop = stop | F.contains(low, F.lit(word))
    after = F.col("line_no") > F.col("data_start")
    summed = rows.groupBy(
        "file", F.when(not_blank(), width_by(F.col("line"), F.col("delimiter"))).alias("n_cols"), width_by(F.trim("line"), F.col("delimiter")).alias("trimmed")
    ).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(after & stop, F.col("line_no"))).alias("stop_line"), F.min(F.when(after, F.col("line_no"))).alias("first_line"))
    modes = summed.filter(F.col("n_cols").isNotNull()).groupBy("file", "n_cols").agg(F.sum("n").alias("n")).groupBy("file").agg(F.max_by("n_cols", F.struct(F.col("n"), -F.col("n_cols"))).alias("expected"))
    narrow = F.col("trimmed") < F.greatest(F.lit(2.0), F.coalesce("expected", F.lit(PLATE_COLUMNS)) * 0.5)
    ends = summed.join(modes, "file", "left").groupBy("file").agg(F.least(F.min("stop_line"), F.min(F.when(narrow, F.col("first_line")))).alias("stop_line"))
    lengths = lines.groupBy("file").agg((F.max("line_no") + 1).alias("n_lines"))
    return (
        starts.join(lengths, "file")
        .join(ends, "file", "left")
        .select("file", "data_start", F.coalesce("stop_line", "n_lines").cast("int").alias("data_end"))
    )


def block_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    return (
        lines.join(blocks, "file")
        .filter((F.col("line_no") >= F.col("data_start")) & (F.col("line_no") < F.col("data_end")))
        .select(*lines.columns)
    )


def plain_split(line: Column, delimiter: Column) -> Column:
    """Cut at a delimiter held in a column; each branch has a constant pattern."""
    out = F.array(line)
    for d in reversed(UNIFORM_DELIMITERS):
        out = F.when(delimiter == d, F.split(line, _LITERAL[d], -1)).otherwise(out)
    return out


def quoted_split(line: Column, delimiter: str) -> Column:
    """Cut at a delimiter, keeping quoted fields whole and unescaping doubled quotes."""
    d = _LITERAL[delimiter]
    field = rf'("(?:[^"]|"")*"[^{d}]*|[^{d}]*){d}'
    parts = F.regexp_extract_all(F.concat(line, F.lit(delimiter)), F.lit(field), F.lit(1))
    return F.transform(
        parts,
        lambda x: F.when(x.rlike(r'^\s*".*"\s*$'), F.replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(x),
    )


def split_cells(line: Column, delimiter: Column) -> Column:
    """Trimmed cells of a line; only lines with a quote take the slower path."""
    quoted = F.array(line)
    for d in reversed(DELIMITERS):
        quoted = F.when(delimiter == d, quoted_split(line, d)).otherwise(quoted)
    parts = F.when(~F.contains(line, F.lit('"')), plain_split(line, delimiter)).otherwise(quoted)
    return F.transform(parts, lambda x: F.trim(x))


def to_rows(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """``(file, row, cells)`` with one array per non-blank line."""
    rows = lines.filter(not_blank()).join(delimiters.select("file", "delimiter"), "file")
    return rows.select("file", F.col("line_no").cast("int").alias("row"), split_cells(F.col("line"), F.col("delimiter")).alias("cells"))


def to_cells(lines: DataFrame, delimiters: DataFrame, keep_short: bool = True) -> DataFrame:
    """``(file, row, col, cell)`` with the row being the line number; blank lines give no cells."""
    rows = lines.filter(not_blank()).join(delimiters.select("file", "delimiter"), "file")
    cells = rows.select(
        "file", F.col("line_no").cast("int").alias("row"), split_cells(F.col("line"), F.col("delimiter")).alias("cells")
    )
    if not keep_short:
        cells = cells.filter(F.size("cells") > 1)
    return cells.select("file", "row", F.posexplode("cells").alias("col", "cell"))


def pad_rows(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """Cells of every row filled with NULL up to the widest row of the file; columns named ``Col_n``."""
    rows = lines.filter(not_blank()).join(delimiters.select("file", "delimiter"), "file")
    rows = rows.select("file", "line_no", split_cells(F.col("line"), F.col("delimiter")).alias("cells"))
    widest = rows.groupBy("file").agg(F.max(F.size("cells")).alias("n_cols"))
    padded = rows.join(widest, "file").select(
        "file",
        F.col("line_no").cast("int").alias("row"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.get(F.col("cells"), i))).alias("col", "cell"),
    )
    return padded.withColumn("name", F.concat(F.lit("Col_"), (F.col("col") + 1).cast("string")))


def apply_shape_rules(cells: DataFrame, max_cols: int = 50) -> DataFrame:
    """Cells of the files with at least two columns, with ``n_cols`` and ``wide`` for more than ``max_cols``; no column is cut."""
    shape = cells.groupBy("file").agg((F.max("col") + 1).alias("n_cols"))
    return cells.join(shape.filter(F.col("n_cols") >= 2), "file").withColumn("wide", F.col("n_cols") > max_cols)


def rejected_files(cells: DataFrame) -> DataFrame:
    """Files that ``apply_shape_rules`` turns away, as quarantine rows."""
    narrow = cells.groupBy("file").agg((F.max("col") + 1).alias("n_cols"), F.count(F.lit(1)).alias("n_cells")).filter(F.col("n_cols") < 2)
    return narrow.select("file", "n_cells", F.lit("fewer than two columns").alias("reason"))


def empty_plates(failed: DataFrame) -> DataFrame:
    """An 8 x 12 grid of NULL cells for each file that could not be parsed."""
    return failed.select("file", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row")).select(
        "file", "row", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("col"), F.lit(None).cast("string").alias("cell")
    )


def duplicate_headers(lines: DataFrame) -> DataFrame:
    """Whether the comma-separated first line repeats a name."""
    names = F.transform(F.split(F.trim("line"), ","), lambda x: F.trim(x))
    return lines.filter(F.col("line_no") == 0).select(
        "file", (F.size(names) != F.size(F.array_distinct(names))).alias("duplicate_headers")
    )


def correct_data_start(lines: DataFrame, hints: DataFrame) -> DataFrame:
    """First real data line from a hinted start on; then hint + 1; then the hint."""
    line, low = F.col("line"), F.lower("line")
    timed = line.rlike("[0-9]") & (F.contains(line, F.lit(":")) | F.contains(line, F.lit("-")))
    header_like = F.lit(False)
    for word in HEADER_WORDS:
        header_like = header_like | F.contains(low, F.lit(word))
    structured = F.contains(line, F.lit(",")) | F.contains(line, F.lit("\t")) | line.rlike(r"\S\s+\S")
    real = not_blank() & ~F.trim(line).startswith("#")
    data = real & (F.contains(line, F.lit("EVENT_ID:")) | timed | (~header_like & structured))
    hint = F.col("hint")
    rows = lines.join(hints, "file").filter(F.col("line_no") >= hint)
    found = rows.groupBy("file", "hint").agg(
        F.min(F.when(data, F.col("line_no"))).alias("found"),
        F.max(F.when((F.col("line_no") == hint + 1) & not_blank(), F.col("line_no"))).alias("next"),
    )
    return hints.join(found.drop("hint"), "file", "left").select(
        "file", "hint", F.coalesce("found", "next", "hint").cast("int").alias("data_start")
    )


def names_from_first_row(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """Column names taken from the first data row: the key of ``KEY:VALUE``, a short first part, else ``col_i``."""
    row = cells.join(starts, "file").filter(F.col("row") == F.col("data_start"))
    cell = F.col("cell")
    fallback = F.concat(F.lit("col_"), F.col("col").cast("string"))
    part = F.split_part(F.trim(cell), F.lit(","), F.lit(1))
    name = (
        F.when(cell.isNull() | (F.trim(cell) == "") | (F.trim(cell) == "nan"), fallback)
        .when(F.contains(cell, F.lit(":")), F.split_part(cell, F.lit(":"), F.lit(1)))
        .when(F.contains(F.trim(cell), F.lit(",")) & F.length(part).between(1, 19), part)
        .otherwise(fallback)
    )
    return row.select("file", "col", name.alias("name"))


def named_cells(cells: DataFrame, annotation: DataFrame) -> DataFrame:
    """Data cells with the name found in the annotated header row (``col_i`` without one).

    What is known of files and of their columns is settled, so that a long file's cells are not sorted by a few keys to meet it.
    """
    known = settle(annotation.select("file", "header_row", "data_start"), "annotation")
    marked = cells.join(known, "file")
    names = settle(marked.filter(F.col("row") == F.col("header_row")).select("file", "col", F.col("cell").alias("name")), "names")
    fallback = F.concat(F.lit("col_"), F.col("col").cast("string"))
    data = marked.filter(F.col("row") >= F.col("data_start")).select("file", "row", "col", "cell")
    return data.join(names, ["file", "col"], "left").select(
        "file", "row", "col", F.coalesce(F.when(F.col("name") != "", F.col("name")), fallback).alias("name"), "cell"
    )


def simple_parse(lines: DataFrame) -> DataFrame:
    """First line as header, the others cut at commas; files of one line give nothing."""
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("last"))
    header = lines.filter(F.col("line_no") == 0).select("file", F.posexplode(F.split("line", ",")).alias("col", "name"))
    body = lines.join(sizes.filter(F.col("last") >= 1), "file").filter((F.col("line_no") > 0) & not_blank())
    cells = body.select("file", F.col("line_no").cast("int").alias("row"), F.posexplode(F.split("line", ",")).alias("col", "cell"))
    return cells.join(header, ["file", "col"]).select("file", "row", "col", F.trim("name").alias("name"), F.trim("cell").alias("cell"))


def parse_log(cells: DataFrame, delimiters: DataFrame, headers: DataFrame) -> DataFrame:
    """One line per file: delimiter, shape and header rows."""
    shape = cells.groupBy("file").agg(
        F.count_distinct("row").alias("n_rows"), (F.max("col") + 1).cast("int").alias("n_cols")
    )
    return shape.join(delimiters.select("file", "delimiter"), "file").join(headers, "file", "left")
