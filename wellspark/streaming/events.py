"""Structured Streaming jobs over the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wellspark.session import work_folder

# Request and token budget of one minute.
REQUESTS_PER_MINUTE = 50
TOKENS_PER_MINUTE = 20000


#: A moment after all events: a row with this time lets the watermark pass every open window.
LAST_MOMENT = "9999-01-01 00:00:00"


def read_events(spark: SparkSession, folder: str, glob: str = "events*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream; ``at`` is the zoned event time a watermark needs."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def end_mark(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of one row ``at`` after all events, for a run that reads everything in one batch.

    Rows of the batch that brings the mark are not late yet; after it the
    watermark stands behind every window, which Spark then closes in a last batch
    without data.  The mark's own window never closes.
    """
    spark.range(1).select(F.lit(LAST_MOMENT).cast("timestamp").alias("at")).write.parquet(folder)
    return spark.readStream.schema("at timestamp").parquet(folder)


def _marked(rows: DataFrame, mark: DataFrame | None) -> DataFrame:
    """``rows`` and the mark, which comes after all filters and joins, so that none can drop it."""
    if mark is None:
        return rows
    return rows.unionByName(mark.select("at", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "at"]))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything that is there, then read what was written.

    Output and checkpoint lie in the shared work folder, so a restarted driver or
    executor continues from the last committed batch.
    """
    spark = stream.sparkSession
    base = work_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def daily_counters(events: DataFrame, users: DataFrame, delay: str = "1 day", mark: DataFrame | None = None) -> DataFrame:
    """Usage per organisation, metric and day; events older than the watermark are dropped."""
    owner = users.select(F.col("id").alias("user_id"), "organization_id")
    owned = _marked(events.join(owner, "user_id").select("at", "organization_id", "event_type", "value"), mark)
    counted = owned.withWatermark("at", delay).groupBy(
        F.window("at", "1 day").alias("w"), "organization_id", F.col("event_type").alias("metric_type")
    ).agg(F.count(F.lit(1)).alias("event_count"), F.sum("value").alias("total_value"))
    return counted.select(F.col("w.start").alias("window_start"), "organization_id", "metric_type", "event_count", "total_value")


def budget(events: DataFrame, tokens: Column, delay: str = "10 minutes", mark: DataFrame | None = None) -> DataFrame:
    """Requests and tokens of each clock minute, and whether they exceed the budget."""
    asked = _marked(events.select("at", tokens.alias("tokens")), mark)
    used = asked.withWatermark("at", delay).groupBy(F.window("at", "60 seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens")
    )
    over = (F.col("requests") > REQUESTS_PER_MINUTE) | (F.col("tokens") > TOKENS_PER_MINUTE)
    return used.select(F.col("w.start").alias("window_start"), "requests", "tokens", over.alias("over_budget"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", mark: DataFrame | None = None) -> DataFrame:
    """Closed activity sessions per user."""
    found = _marked(events.select("at", "user_id"), mark).withWatermark("at", delay).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def sliding_activity(events: DataFrame, span: str = "7 days", step: str = "1 day", delay: str = "1 day", mark: DataFrame | None = None) -> DataFrame:
    counted = _marked(events.select("at", "event_type"), mark).withWatermark("at", delay).groupBy(F.window("at", span, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")

