"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspark.llm.batches import WORD
from wellspark.session import settle

#: A source's shuffled order is cut into this many ranges, so that a hot source is summed by many tasks.
RANGES = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``target`` for every row of ``sizes`` (``_key``, ``source``, ``source_size``), one row per source.

    Sources by code point, nulls last, take the weights in turn and divide
    ``share`` times all words; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight.  The level is found along the
    sources ordered by the level at which each is full.  One row per source is
    all that meets here.
    """
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy("full", F.asc_nulls_last("source"))
    full = weighted.withColumn("full", F.col("cap") / F.col("weight"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - before) / open_weight
    levels = full.withColumn("level", level)
    chosen = F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True).over(everything)
    return levels.withColumn("chosen", chosen).select("_key", "source_size", F.coalesce(F.least(F.col("weight") * F.col("chosen"), F.col("cap")), F.col("cap")).alias("target"))


#: What the passes are sorted by: finish time, then what tells rows of one moment apart.
ORDER = ["finish", "key", "order", "id", "pass"]


def schedule(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs`` (``id``, ``source``, ``size``, ``own`` and what rides along in ``row``) with ``_source_size``, ``_target`` and ``_passes``: per pass over its source ``ORDER`` as a struct.

    Each source's documents are shuffled by the md5 of id and text.  A document's
    virtual finish time in pass e is (words of its source up to and with it + e *
    source size) / target.
    """
    mixed = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("own")).cast("binary"))
    keyed = docs.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).withColumn("_order", mixed)
    keyed = keyed.withColumn("_range", F.conv(F.substring("_order", 1, 2), 16, 10).cast("int"))
    ranges = settle(keyed.groupBy("_key", "_range").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "ranges")
    sizes = ranges.groupBy("_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    before = F.sum("words").over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("_key", "_range", F.coalesce(before, F.lit(0)).alias("_before")).join(source_targets(sizes, weights, share, most), "_key")
    offsets = offsets.withColumnsRenamed({"source_size": "_source_size", "target": "_target"})
    inside = F.sum("size").over(Window.partitionBy("_key", "_range").orderBy("_order", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    reached = keyed.join(offsets, ["_key", "_range"]).withColumn("_reached", F.col("_before") + inside)

    def one(e: Column) -> Column:
        finish = F.when(F.col("_target") > 0, (F.col("_reached") + e * F.col("_source_size")).cast("double") / F.col("_target")).otherwise(0.0)
        return F.struct(finish.alias("finish"), F.col("_key").alias("key"), F.col("_order").alias("order"), F.col("id").alias("id"), e.cast("int").alias("pass"))

    return reached.withColumn("_passes", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), one)).drop("_key", "_order", "_range", "_before", "_reached")


def cut_point(scheduled: DataFrame, share: float = 1.5, most: int = 2) -> tuple[tuple | None, int]:
    """The pass in which the budget ends, as ``ORDER``, and the words it still gets; no pass if the budget takes all.

    All passes are sorted by range over all partitions.  The driver sums the words
    of the partitions, one number each, and only the partition that crosses the
    budget is summed row by row.
    """
    passes = scheduled.select("size", F.explode("_passes").alias("p")).select("size", "p.*").filter("size > 0")
    ordered = settle(passes.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "passes")
    totals = sorted((r["part"], r["words"]) for r in ordered.groupBy("part").agg(F.sum("size").alias("words")).collect())
    left = math.floor(min(share, most) * sum(w for _, w in totals) / most)
    for part, words in totals:
        if words > left:
            upto = F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
            crossing = ordered.filter(F.col("part") == part).withColumn("upto", upto).filter(F.col("upto") > left).orderBy("upto").first()
            return tuple(crossing[c] for c in ORDER), left - (crossing["upto"] - crossing["size"])
        left -= words
    return None, 0


def _words(at: tuple | None, rest: int, id_type) -> Column:
    """Words taken in each of ``_passes``: all before the cut, the rest at it, none after it."""
    if at is None:
        return F.transform("_passes", lambda p: F.col("size"))
    names = [F.lit(v).cast(id_type if c == "id" else t).alias(c) for v, c, t in zip(at, ORDER, ("double", "string", "string", "", "int"))]
    cut = F.struct(*names)
    return F.transform("_passes", lambda p: F.when(p < cut, F.col("size")).when(p == cut, F.lit(rest).cast("long")).otherwise(F.lit(0).cast("long")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    own = F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), own.alias("own"), *more)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: the id, ``size``, ``source_size``, ``target``, ``taken``.

    The passes of all documents are sorted by virtual finish time over all
    partitions and cut where the total budget, ``share`` times all words, ends; the
    pass at the cut gets the words still missing.  Null and empty texts have size 0
    and are taken with 0 words.  A null source is a source of its own, the last.
    Repeated rows each count; rows of equal place are alike, so reruns agree.  No
    words at all give targets of 0; an empty table gives no rows; other columns are not read.
    """
    limits = {k: v for k, v in options.items() if k in ("share", "most")}
    done = settle(schedule(settle(_sized(docs, id_col, text_col, source_col), "sizes"), **options), "schedule")
    words = _words(*cut_point(done, **limits), docs.schema[id_col].dataType)
    taken = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + w)
    return done.select(F.col("id").alias(id_col), "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sort: bool = True, **options) -> DataFrame:
    """The documents the mix takes, once per pass, with the columns of ``docs``; the one at the cut has the words still missing.

    The sort and the cut run on sizes alone; texts are moved once, to get their
    place in their source.  With ``sort`` the rows themselves come in the order of their finish times.
    """
    limits = {k: v for k, v in options.items() if k in ("share", "most")}
    cut = cut_point(schedule(settle(_sized(docs, id_col, text_col, source_col), "sizes"), **options), **limits)
    text = F.col(f"row.{text_col}")
    rows = _sized(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    served = schedule(rows, **options).withColumn("_s", F.explode(F.arrays_zip(F.col("_passes").alias("at"), _words(*cut, docs.schema[id_col].dataType).alias("words")))).filter("_s.words > 0")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_s.words").cast("int")), " ")
    out = served.withColumn("row", F.col("row").withField(text_col, F.when(F.col("_s.words") < F.col("size"), head).otherwise(text)))
    if sort:
        out = out.repartitionByRange("_s.at").sortWithinPartitions("_s.at")
    return out.select("row.*")
