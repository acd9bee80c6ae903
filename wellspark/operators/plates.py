"""Plate grids: cutting, reshaping, labelling, checking and joining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wellspark.functions.ordered import fill_forward, int_chunk
from wellspark.functions.values import null_token, to_num
from wellspark.operators.structure import not_blank, split_cells
from wellspark.session import settle

# Well formats, the id used when a plate has none, and the id patterns in order.
FORMATS = {96: (8, 12, r"^[A-H]([1-9]|1[0-2])$"), 384: (16, 24, r"^[A-P]([1-9]|1[0-9]|2[0-4])$")}
UNKNOWN_PLATE = "Unknown"
ANY_WELL = r"^[A-H]\d{1,2}$"
PLATE_ID_PATTERNS = [r"Plate\s*ID\s*(\w+)", r"Plate\s*(\w+)", r"Sample\s*Plate\s*(\w+)", r"^(\w+)$"]


def well_id(row: Column, col: Column) -> Column:
    """``A1`` for the top left corner (0, 0)."""
    return F.concat(F.char(F.lit(65) + row), (col + 1).cast("string"))


def correct_end_row(cells: DataFrame, annotation: DataFrame) -> DataFrame:
    """A block annotated 1..7 reaches row 8 when that row has a value in the block's columns."""
    eighth = (
        cells.filter(F.col("row") == 8)
        .join(annotation, "file")
        .filter(F.col("col").between(F.col("start_col"), F.col("end_col")))
        .groupBy("file")
        .agg(F.max(null_token("cell").isNotNull()).alias("has_eighth"))
    )
    extend = (F.col("start_row") == 1) & (F.col("end_row") == 7) & F.coalesce("has_eighth", F.lit(False))
    return (
        annotation.join(eighth, "file", "left")
        .withColumn("end_row", F.when(extend, F.lit(8)).otherwise(F.col("end_row")))
        .drop("has_eighth")
    )


#: Rows and columns of a bin of the rectangle join.
BIN = 8
#: Rectangles of a bin that meet its cells in one place.
PART = 1024


def binned_join(cells: DataFrame, rectangles: DataFrame, size: int = BIN) -> DataFrame:
    """Cells beside the rectangles that reach into their bin, before the bounds are compared.

    A file's grid is cut into square bins.  A rectangle is opened to the bins it
    reaches, a cell lies in one, and only they meet; so the rows joined follow the
    rectangles' own sizes, not cells times rectangles of a file.

    Rectangles that crowd in a bin are dealt over parts of it, and the bin's cells
    go to each of them; then all meet by a shuffle, as the cells of crowded bins
    often lie in one split.
    """
    bins = ["file", "_rb", "_cb"]

    def place(name: str) -> Column:
        return F.floor(F.col(name) / size).cast("int")

    rows, cols = F.sequence(place("start_row"), place("end_row")), F.sequence(place("start_col"), place("end_col"))
    opened = rectangles.withColumn("_rb", F.explode(rows)).withColumn("_cb", F.explode(cols))
    placed = cells.withColumn("_rb", place("row")).withColumn("_cb", place("col"))
    crowded = settle(opened.groupBy(*bins).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts")).filter("_parts > 1"), "crowded-bins")
    if crowded.isEmpty():
        return placed.join(opened, bins)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = opened.join(crowded, bins, "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rectangles.columns]), parts).cast("int")).drop("_parts")
    copied = placed.join(crowded, bins, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return copied.join(dealt.hint("merge"), [*bins, "_part"]).drop("_part")


def cut_blocks(cells: DataFrame, annotation: DataFrame) -> DataFrame:
    """Cells inside the annotated rectangles, positions relative to their corner; rectangles turned inside out hold none."""
    inside = F.col("row").between(F.col("start_row"), F.col("end_row")) & F.col("col").between(F.col("start_col"), F.col("end_col"))
    extra = [c for c in annotation.columns if c not in ("file", "start_row", "end_row", "start_col", "end_col")]
    proper = annotation.filter("start_row <= end_row and start_col <= end_col")
    return (
        binned_join(cells, proper)
        .filter(inside)
        .select("file", *extra, (F.col("row") - F.col("start_row")).alias("r"), (F.col("col") - F.col("start_col")).alias("c"), "cell")
    )


def cut_lines(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """``correct_end_row`` and ``cut_blocks`` in one pass over raw lines.

    ``facts`` is the annotation with the delimiter of each file.  Whether row 8
    extends a 1..7 block shows in that row's own array, so neither a second pass
    over the cells nor an aggregate is needed.
    """
    extra = [c for c in facts.columns if c not in ("file", "start_row", "end_row", "start_col", "end_col", "delimiter", "score")]
    near = lines.filter(not_blank()).join(facts, "file").filter(F.col("line_no").between(F.col("start_row"), F.greatest(F.col("end_row"), F.lit(8))))
    part = F.slice(split_cells(F.col("line"), F.col("delimiter")), F.col("start_col") + 1, F.col("end_col") - F.col("start_col") + 1)
    eighth = (F.col("start_row") == 1) & (F.col("end_row") == 7) & (F.col("line_no") == 8) & F.exists("part", lambda c: null_token(c).isNotNull())
    inside = (F.col("line_no") <= F.col("end_row")) | eighth
    return near.withColumn("part", part).filter(inside).select(
        "file", *extra, (F.col("line_no") - F.col("start_row")).cast("int").alias("r"), F.posexplode("part").alias("c", "cell")
    )


def grid_to_wells(block: DataFrame, value: str) -> DataFrame:
    """One row per well: ``plate_id``, ``well_id``, the trimmed text and its number."""
    text = null_token("cell")
    return block.select(
        F.coalesce(F.col("plate_id"), F.lit(UNKNOWN_PLATE)).alias("plate_id"),
        well_id(F.col("r"), F.col("c")).alias("well_id"),
        text.alias(value),
        to_num(text).alias("value_num"),
    )


def wells_to_grid(wells: DataFrame, value: str) -> DataFrame:
    """Inverse of ``grid_to_wells`` in long form."""
    return wells.select(
        "plate_id",
        (F.ascii(F.col("well_id")) - 65).alias("r"),
        (F.substring("well_id", 2, 3).cast("int") - 1).alias("c"),
        F.col(value).alias("cell"),
    )


def wide_grid_to_wells(grid: DataFrame, keys: list[str], row: str, columns: list[str], value: str) -> DataFrame:
    """A grid stored as one table row per plate row; the named columns are wells 1, 2, …"""
    numbered = grid.select(*keys, row, *[F.col(c).cast("string").alias(str(i + 1)) for i, c in enumerate(columns)])
    long = numbered.unpivot([*keys, row], [str(i + 1) for i in range(len(columns))], "n", "cell")
    return long.select(*keys, F.concat(F.char(F.lit(65) + F.col(row)), F.col("n")).alias("well_id"), null_token("cell").alias(value))


def well_files(cells: DataFrame) -> DataFrame:
    """Files that already have one row per well: header ``Well`` and only well ids below it."""
    column = cells.filter(F.col("col") == 0)
    return column.groupBy("file").agg(
        F.max(F.when(F.col("row") == 0, F.col("cell") == "Well")).alias("headed"),
        F.every(F.when(F.col("row") > 0, F.coalesce(F.col("cell").rlike(r"^[A-H]\d+$"), F.lit(False))).otherwise(F.lit(True))).alias("all_wells"),
    ).filter(F.col("headed") & F.col("all_wells")).select("file")


def well_file_rows(cells: DataFrame) -> DataFrame:
    """Long form of well files: plate id is the file stem, data columns become ``raw <name>``."""
    good = cells.join(well_files(cells), "file", "left_semi")
    names = good.filter(F.col("row") == 0).select("file", "col", F.col("cell").alias("name"))
    wells = good.filter((F.col("col") == 0) & (F.col("row") > 0)).select("file", "row", F.col("cell").alias("well_id"))
    values = good.filter((F.col("row") > 0) & (F.col("col") > 0))
    stem = F.regexp_replace("file", r"\.[A-Za-z0-9]+$", "")
    return (
        values.join(names, ["file", "col"])
        .join(wells, ["file", "row"])
        .select(stem.alias("plate_id"), "well_id", F.concat(F.lit("raw "), F.col("name")).alias("field"), null_token("cell").alias("value"), "name")
    )


def well_file_mapping(cells: DataFrame) -> DataFrame:
    """Map value of well files: the Treatment column, else Sample, else ``Unknown``."""
    rows = well_file_rows(cells)
    picked = rows.groupBy("plate_id", "well_id").agg(
        F.max(F.when(F.col("name") == "Treatment", F.col("value"))).alias("t"),
        F.max(F.when(F.col("name") == "Sample", F.col("value"))).alias("s"),
    )
    return picked.select("plate_id", "well_id", F.coalesce("t", "s", F.lit("Unknown")).alias("raw mapping"))


def plate_segments(lines: DataFrame) -> DataFrame:
    """Each ``Plate ID`` label starts a segment; rows are numbered from the label line.

    The label is carried down the file chunk by chunk, so one huge file is not
    one task.
    """
    label = F.when(
        F.col("line").rlike(r"(?i)^\s*plate\s*id"),
        F.struct(F.regexp_extract("line", r"(?i)^\s*(plate\s*id\s*[A-Za-z0-9_]+)", 1).alias("text"), F.col("line_no").alias("at")),
    )
    filled = fill_forward(lines, ["file"], ["line_no"], int_chunk("line_no"), {"label": label})
    return filled.filter(F.col("label").isNotNull() & (F.col("line_no") > F.col("label.at"))).select(
        "file", "line_no", "line", F.col("label.text").alias("label"), (F.col("line_no") - F.col("label.at") - 1).cast("int").alias("r")
    )


def pad_plate_id(c: Column) -> Column:
    """``A1`` becomes ``A01``; everything else is kept."""
    c = F.trim(c)
    return F.when(c.rlike(r"^[A-Za-z]\d$"), F.concat(F.substring(c, 1, 1), F.lit("0"), F.substring(c, 2, 1))).otherwise(c)


def core_plate_id(c: Column) -> Column:
    """The id inside texts such as ``Plate ID 7``; the first pattern that fits decides."""
    c = F.trim(c)
    out = c
    for pattern in reversed(PLATE_ID_PATTERNS):
        out = F.when(c.rlike("(?iU)" + pattern), F.regexp_extract(c, "(?iU)" + pattern, 1)).otherwise(out)
    return out


def check_plates(wells: DataFrame, value: str, expected: int = 96) -> DataFrame:
    """Per plate: wells, distinct wells, bad ids, missing share, and a verdict.

    Duplicates and bad ids are counted from a per-well pre-aggregate, so a plate
    with very many repeated rows is combined before it is shuffled.
    """
    rows, cols, pattern = FORMATS[expected]
    per_well = wells.groupBy("plate_id", "well_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_null")
    )
    bad = F.coalesce(~F.col("well_id").rlike(pattern), F.lit(True))
    out = per_well.groupBy("plate_id").agg(
        F.sum("n").alias("n_rows"),
        F.count("well_id").alias("n_wells"),
        F.count_if(bad).alias("n_bad"),
        F.sum("n_null").alias("n_missing"),
    )
    missing_pct = F.round(F.col("n_missing") * 100.0 / F.col("n_rows"), 4)
    return out.select(
        "plate_id", "n_rows", "n_wells", "n_bad", "n_missing",
        missing_pct.alias("missing_pct"),
        (F.col("n_wells") == expected).alias("complete"),
        (missing_pct > 50).alias("mostly_missing"),
        (F.col("n_bad") == 0).alias("is_valid"),
    )


def check_plate_columns(wells: DataFrame, required: tuple[str, ...] = ("plate_id", "well_id"), expected: int = 96) -> DataFrame:
    """One row per plate and value column: wells, bad ids, missing cells of the column, warnings; and one for each required column that is missing.

    All columns are counted in one pass: a plate's buffer is an array with a
    counter for every value column, summed in the tasks per well and then per plate.
    """
    absent = [c for c in required if c not in wells.columns]
    plate = F.col("plate_id").cast("string") if "plate_id" in wells.columns else F.lit(None).cast("string")
    well = F.col("well_id").cast("string") if "well_id" in wells.columns else F.lit(None).cast("string")
    values = [c for c in wells.columns if c not in required]
    _, _, pattern = FORMATS[expected]
    marks = wells.select(plate.alias("plate_id"), well.alias("well_id"), *[F.col(f"`{c}`").isNull().cast("long").alias(f"_{i}") for i, c in enumerate(values)])
    per_well = marks.groupBy("plate_id", "well_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(values))])
    bad = F.col("well_id").isNotNull() & ~F.col("well_id").rlike(pattern)
    per_plate = per_well.groupBy("plate_id").agg(
        F.sum("n").alias("n_rows"), F.count("well_id").alias("n_wells"), F.count_if(bad).alias("n_bad"), F.array(*[F.struct(F.lit(c).alias("column"), F.sum(f"_{i}").alias("n_missing")) for i, c in enumerate(values)]).alias("columns")
    )
    missing = F.round(F.col("n_missing") * 100.0 / F.col("n_rows"), 4)
    told = per_plate.select("plate_id", "n_rows", "n_wells", "n_bad", F.inline_outer("columns")).withColumn("missing_pct", missing)
    warnings = F.array_compact(F.array(
        *[F.lit(f"Missing required column: {c}") for c in absent],
        F.when(F.col("n_bad") > 0, "Invalid well ID format"), F.when(F.col("n_wells") != expected, F.concat(F.lit(f"Expected {expected} wells, found "), F.col("n_wells").cast("string"))),
        F.when(F.col("missing_pct") > 50, F.concat(F.lit("Column '"), "column", F.lit("' has "), F.format_string("%.1f", "missing_pct"), F.lit("% missing data"))),
    ))
    return told.select("plate_id", "column", "n_rows", "n_wells", "n_bad", "n_missing", "missing_pct", F.array_join(warnings, "; ").alias("warnings"), F.lit(not absent).alias("is_valid"))


def bad_wells(wells: DataFrame, expected: int = 96) -> DataFrame:
    """Every bad well id of each plate with the number of its rows."""
    bad = wells.filter(F.coalesce(~F.col("well_id").rlike(FORMATS[expected][2]), F.lit(True)))
    return bad.groupBy("plate_id", "well_id").agg(F.count(F.lit(1)).alias("n_rows"))


def run_summary(wells: DataFrame, keys: tuple[str, str] = ("plate_id", "well_id")) -> DataFrame:
    """Counts of a finished well table, with column counts by kind."""
    data = [c for c in wells.columns if c.startswith("raw") and c != "raw mapping"]
    mapping = [c for c in wells.columns if c == "raw mapping"]
    protocol = [c for c in wells.columns if c.startswith("protocol_")]
    return wells.agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_distinct(keys[0]).alias("unique_plates")
    ).select(
        "total_samples", "unique_plates",
        F.lit(len(data)).cast("long").alias("data_columns"),
        F.lit(len(mapping)).cast("long").alias("map_columns"),
        F.lit(len(protocol)).cast("long").alias("protocol_columns"),
        F.lit(bool(protocol)).alias("has_protocol"),
    )


def merge_wells(*tables: DataFrame) -> DataFrame:
    """Full outer join on plate and well; a column already present on the left wins.

    Wells without a plate id match nothing: each has a key of its own, so they
    stay single rows and their common id is no hot key.
    """
    keys = ["plate_id", "well_id", "_lone"]

    def fold(left: DataFrame, right: DataFrame) -> DataFrame:
        repeated = [c for c in right.columns if c in left.columns and c not in keys]
        return left.join(right.drop(*repeated), keys, "full_outer")

    def ready(i: int, t: DataFrame) -> DataFrame:
        plate = F.coalesce(F.col("plate_id").cast("string"), F.lit(UNKNOWN_PLATE))
        # A key of the row itself: a task that runs again gives the same.  Equal rows get one key, which they share with no other table.
        lone = F.concat(F.lit(f"{i}:"), F.xxhash64(*[F.col(f"`{c}`") for c in t.columns]).cast("string"))
        return t.withColumn("plate_id", plate).withColumn("_lone", F.when(F.col("plate_id") == UNKNOWN_PLATE, lone).otherwise(""))

    return reduce(fold, [ready(i, t) for i, t in enumerate(tables)]).drop("_lone")


def combine(data: DataFrame | None = None, mapping: DataFrame | None = None, protocol: DataFrame | None = None) -> DataFrame:
    """Whatever inputs exist, merged in the order protocol, data, map."""
    present = [t for t in (protocol, data, mapping) if t is not None]
    if not present:
        raise ValueError("nothing to combine: give data, mapping or protocol")
    return merge_wells(*present)


def column_sets(left: DataFrame, right: DataFrame, name: str = "field") -> DataFrame:
    """Every name found in ``left`` or ``right``: ``both``, ``left only`` or ``right only``."""
    sides = left.select(name, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(name, F.lit(0).alias("l"), F.lit(1).alias("r")))
    found = sides.groupBy(name).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return found.select(name, F.when(F.col("r") == 0, "left only").when(F.col("l") == 0, "right only").otherwise("both").alias("found_in"))


def sort_wells(wells: DataFrame) -> DataFrame:
    """A1, A2, …, A10 rather than the text order A1, A10, A2."""
    return wells.orderBy("plate_id", F.substring("well_id", 1, 1), F.substring("well_id", 2, 3).try_cast("int"), "well_id")
