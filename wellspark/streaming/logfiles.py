"""New log files parsed as they arrive and appended to one unified long table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wellspark.operators import logs as lg, structure as st
from wellspark.session import settle
from wellspark.sources.files import to_lines


def watch_folder(spark: SparkSession, folder: str, glob: str = "*.txt", files_per_batch: int | None = None) -> DataFrame:
    """One row per arriving file: its path and whole text (log files are at most 50 MB)."""
    reader = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parse_batch(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(long log rows, quarantined rows, a ledger row per file) of a set of files; delimiter, header and time column are found per file.

    The parsed lines are written once and all three are read from there, so that
    they tell of the same lines: data lines in = rows + quarantine.
    """
    lines = to_lines(texts)
    found = st.detect_delimiter(lines, fixed=True)
    first = lines.filter(st.not_blank() & ~F.trim("line").startswith("#")).groupBy("file").agg(F.min("line_no").alias("header_row"))
    facts = lg.file_facts(lines, found, first.withColumn("data_start", F.col("header_row") + 1))
    timed = settle(lg.with_time(lines, facts, prefix=False), "arrived")
    good, bad = lg.split_bad_times(timed)
    broken = F.col("timestamp").isNull() & F.col("ts_col").isNotNull()
    counts = timed.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~broken).alias("n_rows"), F.count_if(broken).alias("n_quarantined"))
    ledger = texts.select("file", "name", "digest").join(counts, "file", "left").fillna(0, ["n_lines", "n_rows", "n_quarantined"])
    return lg.to_long(good), bad, ledger


def append_batches(out: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]] = parse_batch) -> Callable[[DataFrame, int], None]:
    """Sink with three tables, each batch in its own folder of each: ``rows``, ``quarantine`` and, last, ``ledger``.

    A repeated batch replaces its folders.  A file is known by its name (the last
    two parts of its path) and a digest of its text: one that has come in an
    earlier batch, or twice in this one, is taken once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = batch.select("file", F.array_join(F.slice(F.split("file", "/"), -2, 2), "/").alias("name"), F.sha2("text", 256).alias("digest"), "text")
        fresh = named
        if batch_id > 0 and (seen := _ledger(spark, out)) is not None:
            fresh = named.join(seen.filter(F.col("batch_id") < batch_id).select("name", "digest"), ["name", "digest"], "left_anti")
        once = fresh.groupBy("name", "digest").agg(F.min(F.struct("file", "text")).alias("f")).select("f.file", "name", "digest", "f.text")
        for part, rows in zip(("rows", "quarantine", "ledger"), parse(settle(once, "arriving-files"))):
            rows.write.mode("overwrite").parquet(f"{out}/{part}/batch_id={batch_id}")

    return write


def _ledger(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{out}/ledger")
    except AnalysisException:
        return None


def run_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int | None = None) -> dict[str, DataFrame]:
    """Take in all files that have arrived; ``rows``, ``quarantine`` and ``ledger`` of all batches so far."""
    query = (
        watch_folder(spark, folder, files_per_batch=files_per_batch).writeStream.foreachBatch(append_batches(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return {part: spark.read.parquet(f"{out}/{part}").drop("batch_id") for part in ("rows", "quarantine", "ledger")}
