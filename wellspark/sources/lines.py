"""Text files of any size as numbered lines: a file may lie in many splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wellspark.session import settle
from wellspark.sources.files import read_texts, to_lines

MARK = r"^(FFFE|FEFF)"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, line_no, line)`` of text files, 0-based and exact, blank lines counted; ``file`` is the whole path.

    Spark reads a file in as many splits as its size asks for.  The lines are
    written once with their split and their place in the order of reading, so
    that no later pass depends on how the files were split.  Then two passes
    number them: lines per (file, start of the split), whose running sum is each
    split's first number, and the place within the split.  The text is UTF-8, or
    Latin-1 in a file with a line that is not; UTF-16 files, in which a line feed
    is two bytes, are read whole.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("bytes")
    )
    held = settle(raw, "lines")
    first = F.min_by("bytes", F.struct("start", "seq"))
    files = held.groupBy("file").agg(F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("utf8"), F.hex(F.substring(first, 1, 2)).rlike(MARK).alias("wide"))
    splits = held.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    facts = settle(splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(files, "file"), "splits")
    line = F.when(F.col("utf8"), F.col("bytes").cast("string")).otherwise(F.decode(F.col("bytes"), "ISO-8859-1"))
    narrow = held.join(facts.filter("not wide"), ["file", "start"]).select("file", (F.col("offset") + F.col("seq") - F.col("first")).alias("line_no"), line.alias("line"))
    wide = [r["file"] for r in facts.filter("wide").select("file").distinct().limit(1).collect()]
    if not wide:
        return narrow
    content = spark.read.format("binaryFile").load(paths).join(facts.filter("wide").select(F.col("file").alias("path")).distinct(), "path", "left_semi")
    return narrow.unionByName(to_lines(read_texts(content)).select("file", F.col("line_no").cast("long").alias("line_no"), "line"))
