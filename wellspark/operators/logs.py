"""Instrument logs: finding the time column, aligning files, one time-ordered table.

A log line stays one row with an array of cells until its timestamp is known, so
attaching the time to the values needs no shuffle; per-file facts are joined on
the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wellspark.functions.ordered import fill_forward, int_chunk, number_rows
from wellspark.functions.values import contains_any, null_token, parse_time, to_num
from wellspark.operators.structure import not_blank, split_cells, to_rows
from wellspark.session import settle

# Names of time columns, columns that get no file prefix, and the typing threshold.
TIME_NAMES = ["timestamp", "time", "datetime", "date_time", "created_at", "updated_at", "event_time", "log_time", "recorded_at"]
TIME_PIECES = ["time", "date", "stamp"]
STANDARD_COLUMNS = ["timestamp", "source_file", "timestamp_source", "confidence_score"]
NUMERIC_SHARE = 0.7


def first_values(cells: DataFrame, k: int) -> DataFrame:
    """The first ``k`` non-missing cells of each column; each task keeps ``k`` before the shuffle."""
    known = cells.withColumn("cell", null_token("cell")).filter(F.col("cell").isNotNull())
    rank = F.row_number().over(W.partitionBy("file", "col").orderBy("row"))
    return known.withColumn("k", rank).filter(F.col("k") <= k)


def time_step(low: Column, col: Column, n: Column, parsed: Column) -> Column:
    """1 by exact name, 2 by name and all known values, 3 by any known value in the first three columns."""
    return (
        F.when(low.isin(TIME_NAMES), 1).when(contains_any(low, TIME_PIECES) & (n > 0) & (parsed == n), 2).when((col < 3) & (parsed > 0), 3)
    )


def time_column(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(file, ts_col, ts_name, step)``: by exact name, by name and content, then by content of the first three.

    ``names`` (``file, col, name``) saves collecting the names from the cells.
    """
    if names is None:
        names = cells.groupBy("file", "col").agg(F.min("name").alias("name"))
    known = null_token("cell")
    head = cells.groupBy("file", "col").agg(F.count(known).alias("n"), F.count(parse_time(known)).alias("parsed"))
    step = time_step(F.lower(F.trim("name")), F.col("col"), F.col("n"), F.col("parsed"))
    best = names.join(head, ["file", "col"], "left").withColumn("step", step).filter(F.col("step").isNotNull())
    return best.groupBy("file").agg(F.min(F.struct("step", "col", "name")).alias("m")).select(
        "file", F.col("m.col").alias("ts_col"), F.col("m.name").alias("ts_name"), F.col("m.step").alias("step")
    )


def log_rows(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """``(file, row, cells)`` with one array per line."""
    return to_rows(lines, delimiters)


def header_names(rows: DataFrame, annotation: DataFrame) -> DataFrame:
    """``(file, names)``; a missing name is ``col_i``."""
    head = rows.join(annotation.select("file", F.col("header_row").alias("row")), ["file", "row"])
    named = F.transform("cells", lambda c, i: F.when(c == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(c))
    return head.select("file", named.alias("names"))


def data_rows(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """``(file, row, cells, names)`` of the data lines; one join brings everything known about the file."""
    data = lines.filter(not_blank()).join(heads.select("file", "delimiter", "data_start", "names"), "file").filter(F.col("line_no") >= F.col("data_start"))
    return data.select("file", F.col("line_no").cast("int").alias("row"), split_cells(F.col("line"), F.col("delimiter")).alias("cells"), "names")


def named(rows: DataFrame) -> DataFrame:
    """Named cells opened from row arrays."""
    pairs = F.transform("cells", lambda c, i: F.struct(i.cast("int").alias("col"), F.coalesce(F.get(F.col("names"), i), F.concat(F.lit("col_"), i.cast("string"))).alias("name"), c.alias("cell")))
    return rows.select("file", "row", F.inline(pairs))


def time_column_of_rows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``time_column`` over row arrays; a file with an exact time name in its header needs no look at its values."""
    columns = heads.select("file", F.posexplode("names").alias("col", "name"))
    exact = heads.filter(F.exists("names", lambda n: F.lower(F.trim(n)).isin(TIME_NAMES))).select("file")
    return time_column(named(rows.join(exact, "file", "left_anti")), columns)


def file_facts(lines: DataFrame, delimiters: DataFrame, annotation: DataFrame) -> DataFrame:
    """``(file, delimiter, data_start, names, ts_col)``: all that is needed to read a file, settled as one small table.

    Every annotated file is in it: without a known delimiter with a comma,
    without a header line with no names, without a time column with a NULL one.
    """
    known = annotation.join(delimiters.select("file", "delimiter"), "file", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(",")))
    # Header rows are found among the lines up to the deepest header; one number comes to the driver.
    deepest = annotation.agg(F.max("header_row")).first()[0]
    names = header_names(log_rows(lines.filter(F.col("line_no") <= F.lit(deepest)), known), known)
    named_files = known.join(names, "file", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    heads = settle(named_files.select("file", "delimiter", "data_start", "names"), "log-heads")
    times = time_column_of_rows(data_rows(lines, heads), heads)
    return settle(heads.join(times.select("file", "ts_col"), "file", "left"), "log-facts")


def file_prefix(file: Column) -> Column:
    """File name without ending and without the usual ``_log`` and ``_data`` parts."""
    out = file
    for piece in (".txt", ".csv", "_log", "_data"):
        out = F.replace(out, F.lit(piece), F.lit(""))
    return out


def prefixed(file: Column, name: Column) -> Column:
    return F.when(name.isin(STANDARD_COLUMNS), name).otherwise(F.concat(file_prefix(file), F.lit("_"), name))


def with_time(lines: DataFrame, facts: DataFrame, prefix: bool = True) -> DataFrame:
    """Data rows with their parsed time and column names (prefixed by file if asked)."""
    data = lines.filter(not_blank()).join(facts, "file").filter(F.col("line_no") >= F.col("data_start"))
    data = data.withColumn("cells", split_cells(F.col("line"), F.col("delimiter")))
    stamp = F.get(F.col("cells"), F.col("ts_col"))
    shown = F.transform("names", lambda n: prefixed(F.col("file"), n)) if prefix else F.col("names")
    return data.select(
        F.col("file").alias("source_file"), F.col("line_no"), parse_time(stamp).alias("timestamp"), stamp.alias("raw_timestamp"), "ts_col", shown.alias("names"), "cells",
    )


def split_bad_times(timed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a time or of files without a time column, quarantined rows)."""
    bad_time = F.col("timestamp").isNull() & F.col("ts_col").isNotNull()
    good = timed.filter(~bad_time)
    bad = timed.filter(bad_time).select(
        F.col("source_file").alias("source"), F.col("line_no").cast("string").alias("key"), F.lit("data_processing").alias("category"),
        F.lit("medium").alias("severity"), F.concat(F.lit("unparseable timestamp: "), F.coalesce("raw_timestamp", F.lit(""))).alias("message"),
        F.lit(True).alias("recoverable"),
    )
    return good, bad


def to_long(timed: DataFrame, source: str = "original") -> DataFrame:
    """``(source_file, line_no, timestamp, timestamp_source, column, value)`` without the time column itself."""
    pairs = F.filter(
        F.transform("names", lambda n, i: F.struct(i.alias("i"), n.alias("column"), null_token(F.get(F.col("cells"), i)).alias("value"))),
        lambda p: ~p["i"].eqNullSafe(F.col("ts_col")),
    )
    origin = F.when(F.col("ts_col").isNull(), "none").otherwise(source)
    return timed.select("source_file", "line_no", "timestamp", origin.alias("timestamp_source"), F.inline(pairs)).drop("i")


def column_names(facts: DataFrame, prefix: bool = True, limit: int = 5000) -> list[str]:
    """Sorted union of value column names, from the headers of all files and not from their data.

    Too many is an error, never a cut.
    """
    shown = prefixed(F.col("file"), F.col("n")) if prefix else F.col("n")
    heads = facts.select("file", "ts_col", F.posexplode("names").alias("i", "n")).filter(~F.col("i").eqNullSafe(F.col("ts_col")))
    found = [r[0] for r in heads.select(shown.alias("n")).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} columns; keep the long form")
    return sorted(found)


def to_wide(timed: DataFrame, names: list[str]) -> DataFrame:
    """``timestamp``, the given columns, ``source_file``: each value is taken from the row's own array, without a pivot."""
    def value(name: str) -> Column:
        at = F.array_position("names", F.lit(name))
        return F.when(at > 0, null_token(F.get(F.col("cells"), (at - 1).cast("int")))).alias(name)

    return timed.select("timestamp", *[value(n) for n in names], "source_file", "line_no")


def wide_by_position(lines: DataFrame, facts: DataFrame, names: list[str], prefix: bool = True) -> DataFrame:
    """``to_wide`` straight from lines: where a column stands is looked up once per file, and a row only takes cells by number."""
    shown = F.transform("names", lambda n: prefixed(F.col("file"), n)) if prefix else F.col("names")
    places = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_position("shown", n).cast("int") - 1)
    placed = facts.withColumn("shown", shown).select("file", "delimiter", "data_start", "ts_col", places.alias("places"))
    data = lines.filter(not_blank()).join(placed, "file").filter(F.col("line_no") >= F.col("data_start"))
    data = data.withColumn("cells", split_cells(F.col("line"), F.col("delimiter")))
    values = [null_token(F.get(F.col("cells"), F.get(F.col("places"), F.lit(i)))).alias(n) for i, n in enumerate(names)]
    return data.select(parse_time(F.get(F.col("cells"), F.col("ts_col"))).alias("timestamp"), *values, F.col("file").alias("source_file"), "line_no")


def write_by_header(lines: DataFrame, facts: DataFrame, path: str) -> None:
    """Unprefixed rows grouped by header, for any number of names: a folder for each different header, its values as an array in the header's order.

    ``headers`` holds what the places mean; nothing is gathered on the driver and no name limit applies.
    """
    header = F.sha2(F.to_json("names"), 256)
    marked = facts.withColumn("header", header)
    marked.groupBy("header").agg(F.first("names").alias("names"), F.count(F.lit(1)).alias("n_files")).write.parquet(f"{path}/headers")
    data = lines.filter(not_blank()).join(marked.select("file", "delimiter", "data_start", "ts_col", "header"), "file").filter(F.col("line_no") >= F.col("data_start"))
    cells = split_cells(F.col("line"), F.col("delimiter"))
    rows = data.withColumn("cells", F.transform(cells, null_token)).select(
        F.col("file").alias("source_file"), "line_no", parse_time(F.get(F.col("cells"), F.col("ts_col"))).alias("timestamp"), F.col("cells").alias("values"), "header"
    )
    rows.write.partitionBy("header").parquet(f"{path}/rows")


def in_time_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("timestamp").asc_nulls_last(), "source_file", "line_no")


def type_votes(long: DataFrame) -> DataFrame:
    """Per column: values, numeric values, and whether over 70 % are numeric."""
    votes = long.groupBy("column").agg(F.count("value").alias("n_values"), F.count(to_num("value")).alias("n_numeric"))
    return votes.withColumn("is_numeric", F.coalesce(F.col("n_numeric") / F.nullif(F.col("n_values"), F.lit(0)) > NUMERIC_SHARE, F.lit(False)))


def apply_types(wide: DataFrame, columns: list[str], keep_raw: bool = False) -> DataFrame:
    """Numeric columns by the 70 % rule; ``keep_raw`` keeps the text where a value was lost."""
    counts = wide.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)],
                      *[F.count(to_num(F.col(f"`{c}`"))).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    out = wide
    for i, c in enumerate(columns):
        if counts[f"n{i}"] and counts[f"k{i}"] / counts[f"n{i}"] > NUMERIC_SHARE:
            if keep_raw and counts[f"k{i}"] < counts[f"n{i}"]:
                out = out.withColumn(f"{c}__raw", F.col(f"`{c}`"))
            out = out.withColumn(c, to_num(F.col(f"`{c}`")))
    return out


def impute_times(lines: DataFrame, imputed: DataFrame) -> DataFrame:
    """Rows named by line in the annotation get its time; other rows are left out."""
    times = imputed.select("file", F.col("row_index").alias("line_no"), parse_time("timestamp").alias("timestamp"), "confidence_score")
    joined = lines.join(times, ["file", "line_no"]).filter(F.col("timestamp").isNotNull())
    return joined.withColumn("timestamp_source", F.lit("imputed"))


def imputation_report(lines: DataFrame, imputed: DataFrame) -> DataFrame:
    """Per file: rows with an imputed time, rows without one, and entries that point past the file."""
    rows = lines.filter(not_blank()).select("file", "line_no", F.lit(1).alias("has_row"))
    times = imputed.select("file", F.col("row_index").alias("line_no"), F.lit(1).alias("has_time"))
    both = rows.join(times, ["file", "line_no"], "full_outer")
    return both.groupBy("file").agg(
        F.count_if(F.col("has_row").isNotNull() & F.col("has_time").isNotNull()).alias("covered"),
        F.count_if(F.col("has_time").isNull()).alias("uncovered"), F.count_if(F.col("has_row").isNull()).alias("out_of_range"),
    )


def event_sequence(lines: DataFrame, chunk_rows: int = 65536) -> DataFrame:
    """Dense 0-based position per file for logs without time, counted chunk by chunk."""
    numbered = number_rows(lines, ["file"], [F.col("line_no")], int_chunk("line_no", chunk_rows), "event_sequence")
    return numbered.withColumn("timestamp_source", F.lit("none"))


def match_annotations(files: DataFrame, answers: DataFrame) -> DataFrame:
    """Annotation of each file out of its batch's answer: same name, else one name inside the other, else by position.

    The candidates are the elements of one answer's array, so no pair of rows is formed.
    """
    joined = files.join(answers.select("batch", "files"), "batch", "left")
    name = F.col("name")
    exact = F.filter("files", lambda a: a["file_name"] == name)
    near = F.filter("files", lambda a: F.contains(a["file_name"], name) | F.contains(name, a["file_name"]))
    found = F.coalesce(F.get(exact, 0), F.get(near, 0), F.get(F.col("files"), F.col("position")))
    how = F.when(F.size(exact) > 0, "exact").when(F.size(near) > 0, "contains").when(F.get(F.col("files"), F.col("position")).isNotNull(), "position").otherwise("none")
    return joined.select(*files.columns, found.alias("annotation"), how.alias("matched_by"))


def run_summary(results: DataFrame) -> DataFrame:
    """Files in total, done and failed per method, with the success rate."""
    per = results.groupBy("method").agg(F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    return per.withColumn("success_rate", F.round(F.col("succeeded") * 100.0 / F.col("files"), 4))


def route(profile: DataFrame) -> DataFrame:
    """Fast path for standard files, annotation path for the others."""
    return profile.select("file", F.when(F.col("is_standard"), "fast").otherwise("annotated").alias("method"))


def to_common_zone(df: DataFrame, stamp: str, zone: str, out: str = "timestamp_utc") -> DataFrame:
    """UTC time of local text; an offset in the text wins over the zone column."""
    text = F.col(stamp)
    has_offset = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    own = F.when(has_offset, parse_time(text))
    local = F.to_utc_timestamp(parse_time(F.when(~has_offset, text)), F.col(zone))
    return df.withColumn(out, F.coalesce(own, local))


def resample(df: DataFrame, key: str, at: str, value: str, tie: str, step_seconds: int) -> DataFrame:
    """Last value of each step from a series' first to its last, carried over empty steps.

    Values are reduced to one per step before anything is ordered.  The spine is
    opened day by day, so no single row holds all steps of a long series.
    """
    sec = F.unix_seconds(F.col(at).cast("timestamp"))
    step = (F.floor(sec / step_seconds) * step_seconds).cast("long")
    known = df.filter(F.col(value).isNotNull()).groupBy(key, step.alias("s")).agg(F.max_by(value, F.struct(at, tie)).alias("v"))
    span = known.groupBy(key).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    block = max(step_seconds, 86400 // step_seconds * step_seconds)
    blocks = span.select(key, "lo", "hi", F.explode(F.sequence("lo", "hi", F.lit(block).cast("long"))).alias("b"))
    spine = blocks.select(
        key, F.explode(F.sequence("b", F.least(F.col("b") + block - step_seconds, F.col("hi")), F.lit(step_seconds).cast("long"))).alias("s")
    )
    joined = spine.join(known, [key, "s"], "left")
    filled = fill_forward(joined, [key], ["s"], int_chunk("s", step_seconds * 65536), {"filled": F.col("v")})
    return filled.select(key, F.timestamp_seconds("s").alias("bucket"), F.col("filled").alias(value), F.col("v").isNull().alias("carried"))


def fill_gaps(df: DataFrame, key: str, order: str, value: str, chunk: Column | None = None) -> DataFrame:
    """Missing values carried forward, and as the mean of the nearest known neighbours."""
    chunk = int_chunk(order) if chunk is None else chunk
    v = F.col(value)
    ahead = fill_forward(df, [key], [order], chunk, {"forward_fill": v})
    both = fill_forward(ahead, [key], [order], chunk, {"__next": v}, backward=True)
    mean = F.when(F.col("forward_fill").isNotNull() & F.col("__next").isNotNull(), (F.col("forward_fill") + F.col("__next")) / 2).otherwise(
        F.coalesce("forward_fill", "__next")
    )
    return both.withColumn("neighbour_mean", F.coalesce(v, mean)).drop("__next")




def named_by_first_row(rows: DataFrame) -> DataFrame:
    """``(file, row, col, name, cell)`` with each file's first row as names, for the profile of the file."""
    first = rows.filter(F.col("row") == 0).select("file", F.col("cells").alias("names"))
    return named(rows.filter(F.col("row") > 0).join(first, "file"))


def read_routed(rows: DataFrame, standard: DataFrame, annotation: DataFrame, imputed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both ways of reading, each file by exactly one: ``(long rows, quarantined rows, one ledger row per file)``.

    ``rows`` holds every line once as an array of cells (settled: nothing here
    goes back to the text), ``standard`` (``file, is_standard``) has a row for each
    file.  A standard file is read by its first row; the others by their
    ``annotation``; a file that has none goes to quarantine whole.  A row's time
    comes from its time column, else from ``imputed`` at its line; without either
    it stays with ``timestamp_source`` ``none``, and with an unreadable time it is
    quarantined.  One table of facts decides, so that a file cannot be read twice or never.
    """
    own = standard.filter("is_standard").select("file", F.lit("fast").alias("method"), F.lit(0).cast("long").alias("header_row"), F.lit(1).cast("long").alias("data_start"))
    told = standard.filter("not is_standard").join(annotation, "file", "left").select(
        "file", F.when(F.col("data_start").isNull(), "quarantine").otherwise("annotated").alias("method"), F.col("header_row").cast("long").alias("header_row"), F.col("data_start").cast("long").alias("data_start")
    )
    plan = settle(own.unionByName(told), "log-routes")
    heads = plan.join(header_names(rows, plan.filter("header_row is not null")), "file", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    read = rows.join(heads.filter("method <> 'quarantine'"), "file").filter(F.col("row") >= F.col("data_start"))
    times = time_column_of_rows(read.select("file", "row", "cells", "names"), heads.filter("method <> 'quarantine'"))
    facts = settle(heads.join(times.select("file", "ts_col"), "file", "left"), "log-facts")

    data = rows.join(facts, "file").filter((F.col("method") == "quarantine") | (F.col("row") >= F.col("data_start")))
    marks = imputed.select("file", F.col("row_index").cast("int").alias("row"), parse_time("timestamp").alias("_imputed")).filter(F.col("_imputed").isNotNull())
    stamp = F.get(F.col("cells"), F.col("ts_col"))
    found = data.join(marks.groupBy("file", "row").agg(F.min("_imputed").alias("_imputed")), ["file", "row"], "left").withColumn("_read", parse_time(stamp))
    why = F.when(F.col("method") == "quarantine", "no annotation for a file that is not standard").when(
        F.col("ts_col").isNotNull() & F.col("_read").isNull() & F.col("_imputed").isNull(), F.concat(F.lit("unparseable timestamp: "), F.coalesce(stamp, F.lit("")))
    )
    marked = settle(found.select(
        F.col("file").alias("source_file"), F.col("row").cast("long").alias("line_no"), "method", F.coalesce("_read", "_imputed").alias("timestamp"), "ts_col", "names", "cells",
        F.when(F.col("_read").isNotNull(), "original").when(F.col("_imputed").isNotNull(), "imputed").otherwise("none").alias("timestamp_source"), why.alias("message"),
    ), "routed-rows")
    good, bad = marked.filter("message is null"), marked.filter("message is not null")
    quarantine = bad.select(F.col("source_file").alias("source"), F.col("line_no").cast("string").alias("key"), F.lit("data_processing").alias("category"), F.lit("medium").alias("severity"), "message", F.lit(True).alias("recoverable"))
    counts = marked.groupBy("source_file").agg(F.count_if(F.col("message").isNull()).alias("n_rows"), F.count_if(F.col("message").isNotNull()).alias("n_quarantined"))
    ledger = plan.select("file", "method").join(counts.withColumnRenamed("source_file", "file"), "file", "left").select("file", "method", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_quarantined", F.lit(0)).alias("n_quarantined"))
    return _long_of(good), quarantine, ledger.withColumn("ok", F.col("n_rows") > 0)


def _long_of(rows: DataFrame) -> DataFrame:
    """Long rows of ``read_routed``: every cell but the time, named; cells beyond the header are ``col_i``."""
    pairs = F.filter(
        F.transform("cells", lambda c, i: F.struct(i.alias("i"), F.coalesce(F.get(F.col("names"), i), F.concat(F.lit("col_"), i.cast("string"))).alias("column"), null_token(c).alias("value"))),
        lambda p: ~p["i"].eqNullSafe(F.col("ts_col")),
    )
    return rows.select("source_file", "line_no", "timestamp", "timestamp_source", F.inline(pairs)).drop("i")
