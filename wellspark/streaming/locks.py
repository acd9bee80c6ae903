"""Gated account locks: attempts during a lock are ignored, even good ones.

What an attempt does depends on all before it, yet not on their number: when a
user has been silent for as long as a lock lasts, no lock can still hold, and
all that matters is the failure count, of which 0 to 4 and "5 or more" differ.
So each user is cut at silences, the stretches of a day are a unit, every unit is
read for all six start states at once, and the ends are composed along the units.
A user with half of all attempts is then as many tasks as days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from wellspark.functions.ordered import fill_forward, previous_value, time_chunk
from wellspark.operators.reports import LOCK_AFTER, LOCK_MINUTES
from wellspark.session import settle, work_folder

LOCK = LOCK_MINUTES * 60 * 1_000_000
ROWS_SCHEMA = "user_id long, unit long, at long, event_id long, success boolean, ignored boolean, failed_attempts int, locked_until long"
ENDS_SCHEMA = "user_id long, unit long, known boolean, failed array<long>, counted array<boolean>, until array<long>"
STATE_SCHEMA = "user_id long, unit long, failed long, until long, end_failed long, end_until long"


def step(failed: int, until: int, at: int, success: bool) -> tuple[int, int, bool]:
    """(failures, locked until, ignored) after one attempt; microseconds, 0 for no lock."""
    if at < until:
        return failed, until, True
    if success:
        return 0, 0, False
    failed += 1
    return failed, (at + LOCK if failed >= LOCK_AFTER else 0), False


class Paths:
    """The course of a unit from every start state; courses that have met go on as one.

    From ``LOCK_AFTER`` failures on the course does not depend on the count, which is kept
    as what has been added to it (``counted``) until a good attempt sets it.
    """

    def __init__(self):
        self.courses = [[failed, 0, failed == LOCK_AFTER] for failed in range(LOCK_AFTER + 1)]
        self.starts = [[s] for s in range(LOCK_AFTER + 1)]

    def add(self, at: int, success: bool) -> None:
        for c in self.courses:
            failed, until, ignored = step(c[0], c[1], at, success)
            c[2] = c[2] and (ignored or not success)
            c[0], c[1] = failed, until
        if len(self.courses) > 1:
            met: dict[tuple, int] = {}
            for i, c in enumerate(self.courses):
                if (first := met.setdefault(tuple(c), i)) != i:
                    self.starts[first] += self.starts[i]
                    self.starts[i] = []
            if len(met) < len(self.courses):
                self.courses, self.starts = [c for c, s in zip(self.courses, self.starts) if s], [s for s in self.starts if s]

    def ends(self) -> tuple[list[int], list[bool], list[int]]:
        by_start = {s: c for c, starts in zip(self.courses, self.starts) for s in starts}
        each = [by_start[s] for s in range(LOCK_AFTER + 1)]
        return [c[0] - LOCK_AFTER if c[2] else c[0] for c in each], [c[2] for c in each], [c[1] for c in each]


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per unit the end for every start state, or for the given one in a user's first unit."""
    key, course, known, out = None, None, False, []

    def end() -> None:
        if key is not None:
            out.append((*key, known, *(([course[0]], [False], [course[1]]) if known else course.ends())))

    for frame in frames:
        for user, unit, at, success, failed, until in zip(*(frame[c].tolist() for c in ("user_id", "unit", "at", "success", "start_failed", "start_until"))):
            if (user, unit) != key:
                end()
                key, known = (user, unit), failed >= 0
                course = (failed, until) if known else Paths()
            if known:
                course = step(*course, at, success)[:2]
            else:
                course.add(at, success)
        yield pd.DataFrame(out, columns=["user_id", "unit", "known", "failed", "counted", "until"])
        out = []
    end()
    yield pd.DataFrame(out, columns=["user_id", "unit", "known", "failed", "counted", "until"])


def _compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The start and end of each unit, from a user's first to the last."""
    failed = 0
    for frame in frames:
        out = []
        for user, unit, known, ends, counted, locked, first_failed, first_until in zip(*(frame[c].tolist() for c in ("user_id", "unit", "known", "failed", "counted", "until", "start_failed", "start_until"))):
            start = (first_failed, first_until) if known else (failed, 0)
            i = 0 if known else min(failed, LOCK_AFTER)
            failed = int(ends[i]) + (failed if counted[i] else 0)
            out.append((user, unit, *start, failed, int(locked[i])))
        yield pd.DataFrame(out, columns=["user_id", "unit", "failed", "until", "end_failed", "end_until"])


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, failed, until = None, 0, 0
    for frame in frames:
        ignored, counts, locks = [], [], []
        for user, unit, at, success, start_failed, start_until in zip(*(frame[c].tolist() for c in ("user_id", "unit", "at", "success", "start_failed", "start_until"))):
            if (user, unit) != key:
                key, failed, until = (user, unit), start_failed, start_until
            failed, until, skip = step(failed, until, at, success)
            ignored.append(skip)
            counts.append(failed)
            locks.append(until)
        yield frame[["user_id", "unit", "at", "event_id", "success"]].assign(ignored=ignored, failed_attempts=pd.array(counts, dtype="int32"), locked_until=locks)


def _in_units(attempts: DataFrame, unit_seconds: int) -> DataFrame:
    """Attempts with ``unit``: the day in which their stretch, free of silences as long as a lock, began."""
    order, chunk = ["ts", "event_id"], time_chunk("ts")
    data = attempts.filter("user_id is not null").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("success", F.lit(False)).alias("success"))
    before = previous_value(data, ["user_id"], order, chunk, "ts", "before")
    silent = F.col("before").isNull() | (F.unix_micros("ts") - F.unix_micros("before") >= LOCK)
    filled = fill_forward(before, ["user_id"], order, chunk, {"began": F.when(silent, F.col("ts"))})
    return filled.select("user_id", F.floor(F.unix_seconds("began") / unit_seconds).cast("long").alias("unit"), F.unix_micros("ts").alias("at"), "event_id", "success")


def lock_course(attempts: DataFrame, state: DataFrame | None = None, unit_seconds: int = 86400) -> tuple[DataFrame, DataFrame]:
    """(every attempt with the lock after it, each user's state at the end).

    ``attempts`` has ``user_id``, ``event_id``, ``ts``, ``success``; order is by time,
    then event; those without a user are left out, and a null ``success`` is a failure.
    ``state`` (``user_id, failed, until``) is what earlier attempts have left, none for new users.
    """
    rows = settle(_in_units(attempts, unit_seconds), "lock-units")
    first = rows.groupBy("user_id").agg(F.min("unit").alias("unit"))
    if state is not None:
        first = first.join(state.select("user_id", "failed", "until"), "user_id", "left")
    else:
        first = first.withColumn("failed", F.lit(0)).withColumn("until", F.lit(0))
    first = first.select("user_id", "unit", F.coalesce("failed", F.lit(0)).cast("long").alias("start_failed"), F.coalesce("until", F.lit(0)).cast("long").alias("start_until"))
    first = settle(first, "lock-starts")

    def ordered(started: DataFrame) -> DataFrame:
        return started.repartition("user_id", "unit").sortWithinPartitions("user_id", "unit", "at", "event_id")

    begun = rows.join(first, ["user_id", "unit"], "left").fillna({"start_failed": -1, "start_until": 0})
    ends = settle(ordered(begun).mapInPandas(_ends, ENDS_SCHEMA), "lock-ends")
    # One small row for each day of a user meets here, in order.
    along = ends.join(first, ["user_id", "unit"], "left").fillna({"start_failed": 0, "start_until": 0})
    states = settle(along.repartition("user_id").sortWithinPartitions("user_id", "unit").mapInPandas(_compose, STATE_SCHEMA), "lock-states")
    known = rows.join(states.select("user_id", "unit", F.col("failed").alias("start_failed"), F.col("until").alias("start_until")), ["user_id", "unit"])
    walked = ordered(known).mapInPandas(_walk, ROWS_SCHEMA)
    out = walked.select(
        "user_id", "event_id", F.timestamp_micros("at").alias("ts"), "success", "ignored", "failed_attempts", F.when(F.col("locked_until") > 0, F.timestamp_micros("locked_until")).alias("locked_until")
    )
    last = states.groupBy("user_id").agg(F.max_by(F.struct("end_failed", "end_until"), "unit").alias("e"))
    newest = rows.groupBy("user_id").agg(F.max(F.struct("at", "event_id")).alias("newest"))
    return out, last.join(newest, "user_id").select("user_id", F.col("e.end_failed").alias("failed"), F.col("e.end_until").alias("until"), F.col("newest.at").alias("at"), F.col("newest.event_id").alias("event_id"))


def gated_locks_batch(attempts: DataFrame, unit_seconds: int = 86400) -> DataFrame:
    """Lock state after every attempt of a finished table."""
    return lock_course(attempts, unit_seconds=unit_seconds)[0]


def lock_batches(base: str, unit_seconds: int = 86400, keep_days: int = 30) -> Callable[[DataFrame, int], None]:
    """Sink of a stream of attempts: rows, late rows and the state of all users, each in a folder of the batch.

    A batch starts from the state the one before has written and overwrites its
    own folders, so a repeated batch changes nothing.  An attempt before the
    user's newest one of earlier batches comes too late to be put in order: it
    goes to ``late`` and moves no state.  ``keep_days`` after a user's last attempt,
    by the newest attempt of all, a row that holds no failure expires: it would
    say what a missing row says.  Others stay, as the counter has no end.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = settle(batch.select("user_id", "event_id", "ts", "success"), "lock-batch")
        old = None if batch_id == 0 else spark.read.parquet(f"{base}/state/batch_id={batch_id - 1}")
        if old is None:
            fresh = rows
            rows.limit(0).write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")
        else:
            seen = old.select(F.col("user_id").alias("_user"), F.struct("at", F.col("event_id").alias("event_id")).alias("_newest"))
            told = rows.join(seen, F.col("user_id") == F.col("_user"), "left")
            late = F.coalesce(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id") <= F.col("_newest"), F.lit(False))
            told.filter(late).select(*rows.columns).write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")
            fresh = told.filter(~late).select(*rows.columns)
        out, new = lock_course(fresh, old, unit_seconds)
        out.write.mode("overwrite").parquet(f"{base}/data/batch_id={batch_id}")
        state = new if old is None else new.unionByName(old.join(new.select("user_id"), "user_id", "left_anti").select(*new.columns))
        newest = F.lit(state.agg(F.max("at")).first()[0])
        state = state.filter((F.col("failed") > 0) | (F.col("until") > newest) | (F.col("at") > newest - keep_days * 86400 * 1_000_000))
        state.write.mode("overwrite").parquet(f"{base}/state/batch_id={batch_id}")

    return write


def gated_locks(attempts: DataFrame, name: str = "gated-locks", unit_seconds: int = 86400) -> DataFrame:
    """Run a stream of attempts to its end and return the rows written; each trigger uses the parallel form."""
    spark: SparkSession = attempts.sparkSession
    base = work_folder(spark, name)
    spark.createDataFrame([], "user_id long, event_id long, ts timestamp, success boolean, ignored boolean, failed_attempts int, locked_until timestamp").write.parquet(f"{base}/data/batch_id=-1")
    writer = attempts.writeStream.foreachBatch(lock_batches(base, unit_seconds)).option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/data").drop("batch_id")
