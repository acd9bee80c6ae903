"""Types of headered CSV files, found in the tasks and merged over a lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wellspark.functions.values import NULL_TOKENS
from wellspark.operators.records import split_record, to_records
from wellspark.session import settle
from wellspark.sources.lines import read_lines

#: One bit for each kind of value; a column's kinds are the bits of all its values.
INTEGER, WIDE, FRACTION, FLOAT, BOOLEAN, DATE, TIME, TEXT = (1 << i for i in range(8))


def kind_bit(value: Column) -> Column:
    """The narrowest kind that holds a value; 0 for a missing one."""
    v = F.trim(value)
    whole, fraction = v.rlike(r"^[+-]?[0-9]+$"), v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$")
    return (
        F.when(v.isNull() | v.isin(NULL_TOKENS), 0)
        .when(whole, F.when(v.try_cast("bigint").isNotNull(), INTEGER).otherwise(WIDE))
        .when(fraction, FRACTION)
        .when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+$") | F.lower(v).isin("nan", "inf", "-inf", "infinity", "-infinity"), FLOAT)
        .when(F.lower(v).isin("true", "false"), BOOLEAN)
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull(), DATE)
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}") & v.try_cast("timestamp_ntz").isNotNull(), TIME)
        .otherwise(TEXT)
    )


def joined_type(kinds: int, digits: int = 0, scale: int = 0, exact: bool = False) -> str:
    """The least type that holds all kinds: whole < fraction < float, date < timestamp, anything else is text.

    Fractions are DOUBLE, or DECIMAL of the digits found with ``exact``.
    """
    if kinds == 0:
        return "STRING"
    if kinds == INTEGER:
        return "BIGINT"
    if kinds & ~(INTEGER | WIDE | FRACTION) == 0:
        fits = digits + scale <= 38
        return f"DECIMAL({max(1, digits + scale)},{scale})" if fits and (exact or not kinds & FRACTION) else "DOUBLE"
    if kinds & ~(INTEGER | WIDE | FRACTION | FLOAT) == 0:
        return "DOUBLE"
    if kinds == BOOLEAN:
        return "BOOLEAN"
    if kinds == DATE:
        return "DATE"
    return "TIMESTAMP_NTZ" if kinds & ~(DATE | TIME) == 0 else "STRING"


def column_kinds(spark: SparkSession, paths: str | list[str], delimiter: str = ",") -> DataFrame:
    """``(names, col, kinds, digits, scale, many_lines, files)`` for every different header row and column of the files.

    Kinds are or-ed in each task before anything is shuffled, so a column costs
    one row a task however long the files are.
    """
    lines = read_lines(spark, paths)
    known = settle(lines.filter("line_no = 0").select("file", F.lit(delimiter).alias("delimiter")), "delimiters")
    # In a file without a quote every line is a record, and none of them needs to move.
    quoted = settle(lines.filter(F.contains("line", F.lit('"'))).select("file").distinct(), "quoted-files")
    plain = lines.join(quoted, "file", "left_anti").select("file", F.col("line_no").alias("row"), F.lit(1).cast("long").alias("n_lines"), F.col("line").alias("record"))
    records = settle(to_records(lines.join(quoted, "file", "left_semi"), known), "records").unionByName(plain)
    rows = records.filter(F.col("record").rlike(r"\S")).select("file", "row", "n_lines", split_record(F.col("record"), F.lit(delimiter)).alias("cells"))
    heads = settle(rows.filter("row = 0").select("file", F.col("cells").alias("names")), "headers")
    data = rows.filter("row > 0").join(heads, "file").select("names", "n_lines", F.posexplode("cells").alias("col", "cell"))
    data = data.withColumn("bits", kind_bit(F.col("cell")))
    number, bits = F.regexp_replace(F.trim("cell"), "[+-]", ""), F.col("bits")
    digits = F.when(bits.bitwiseAND(INTEGER | WIDE | FRACTION) > 0, F.length(F.substring_index(number, ".", 1)))
    scale = F.when(bits == FRACTION, F.length(F.regexp_extract(number, r"\.(.*)$", 1)))
    kinds = data.groupBy("names", "col").agg(F.bit_or(bits).alias("kinds"), F.max(digits).alias("digits"), F.max(scale).alias("scale"), F.max(F.col("n_lines") > 1).alias("many_lines"))
    files = heads.groupBy("names").agg(F.sort_array(F.collect_list("file")).alias("files"))
    columns = files.select("names", "files", F.explode(F.sequence(F.lit(0), F.size("names") - 1)).alias("col"))
    return columns.join(kinds, ["names", "col"], "left")


def infer_groups(spark: SparkSession, paths: str | list[str], exact: bool = False) -> list[tuple[str, list[str], bool]]:
    """``(DDL, files, records over several lines)`` for each different header: what one typed read of the group needs.

    Columns named twice get a number.  The driver gets one row per header and column, and the file names that it has listed anyway.
    """
    groups: dict[tuple[str, ...], dict] = {}
    for r in column_kinds(spark, paths).collect():
        one = groups.setdefault(tuple(r["names"]), {"files": r["files"], "types": {}, "many": False})
        one["types"][r["col"]] = joined_type(r["kinds"] or 0, r["digits"] or 0, r["scale"] or 0, exact)
        one["many"] |= bool(r["many_lines"])
    out = []
    for names, one in sorted(groups.items()):
        seen: dict[str, int] = {}
        fields = []
        for i, name in enumerate(names):
            name = name or f"col_{i}"
            seen[name] = seen.get(name, -1) + 1
            quoted = (f"{name}_{seen[name]}" if seen[name] else name).replace("`", "``")
            fields.append(f"`{quoted}` {one['types'][i]}")
        out.append((", ".join(fields), one["files"], one["many"]))
    return out


def read_inferred(spark: SparkSession, paths: str | list[str], exact: bool = False, null_value: str = "") -> list[DataFrame]:
    """One typed DataFrame per header, read once by Spark's own CSV source; ``source_path`` is the file."""
    out = []
    for ddl, files, many in infer_groups(spark, paths, exact):
        reader = spark.read.option("header", True).option("nullValue", null_value).option("quote", '"').option("escape", '"').option("multiLine", many)
        out.append(reader.schema(ddl).csv(files).withColumn("source_path", F.col("_metadata.file_path")))
    return out
