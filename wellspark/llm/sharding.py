"""Shards by jump consistent hashing, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspark.session import settle

#: Multiplier of the 64-bit linear congruential generator that jump hashing draws from (fixed value).
FACTOR = 2862933555777941757
LOW, HALF = (1 << 32) - 1, (1 << 16) - 1
#: Jumps tried first; they grow with the logarithm of the shard count, and a key that needs more gets them.
JUMPS = 64
#: Hexadecimal digits that cut a shard's order into chunks: 4,096 chunks of a shard are numbered apart.
DIGITS = 3


def stable_key(value: Column) -> Column:
    """64 bits of any value's text as a struct of halves ``hi`` and ``lo``; a null counts as an empty text."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.struct(*[F.conv(F.substring(digest, at, 8), 16, 10).cast("long").alias(name) for at, name in ((1, "hi"), (9, "lo"))])


def _times(hi: Column, lo: Column, factor: int) -> tuple[Column, Column]:
    """Halves of (hi, lo) * factor + 1 modulo 2^64, without a product beyond 2^48."""
    above, below = factor >> 32, factor & LOW

    def low_product(x: Column, y: int) -> Column:
        """x * y modulo 2^32."""
        return (x.bitwiseAND(HALF) * y + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(HALF), 16)).bitwiseAND(LOW)

    small, large = lo.bitwiseAND(HALF) * below, F.shiftright(lo, 16) * below
    bottom = small + F.shiftleft(large.bitwiseAND(HALF), 16) + 1
    top = F.shiftright(large, 16) + F.shiftright(bottom, 32) + low_product(hi, below) + low_product(lo, above)
    return top.bitwiseAND(LOW), bottom.bitwiseAND(LOW)


def _jump(state: Column) -> Column:
    """One jump: the next shard count at which the key would move."""
    hi, lo = _times(state["hi"], state["lo"], FACTOR)
    span = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")
    return F.struct(hi.alias("hi"), lo.alias("lo"), state["next"].alias("at"), F.floor((state["next"] + 1).cast("double") * span).alias("next"))


def jump(key: Column, shards: int) -> Column:
    """Struct of ``at``, the key's shard among ``shards``, and ``next``, the first count above it that moves the key (to shard ``next``).

    With one shard more the key is in shard ``next`` if that is ``shards``, else still in ``at``.
    """

    def more(start: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda s, _: F.when(s["next"] < shards, _jump(s)).otherwise(s))

    zero = F.lit(0).cast("long")
    first = more(F.struct(key["hi"].alias("hi"), key["lo"].alias("lo"), zero.alias("at"), zero.alias("next")), min(JUMPS, shards))
    return first if shards <= JUMPS else F.when(first["next"] < shards, more(first, shards)).otherwise(first)


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """One row per row of ``docs``: the id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    A row's shard depends on its id and the number of shards alone; with one
    shard more a row stays or goes to the new one (``grown_shard``).  Size is the
    text's UTF-8 length plus 1; a null text counts as empty.  Rows of a null id
    share a shard.  Slots run from 0 in each shard, in the order of the md5 of id
    and text checksum, then id, size and checksum, nulls first.  Repeated rows
    are counted per input split before any shuffle and opened again at the end,
    so that no window holds the copies of more than a split.  An empty table gives no rows;
    other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sized = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.spark_partition_id().alias("split"))
    counted = sized.groupBy("id", "size", "crc", "split").agg(F.count("*").alias("copies"))
    placed = counted.withColumn("place", jump(stable_key(F.col("id")), shards))
    mixed = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("crc").cast("string")).cast("binary"))
    rows = settle(placed.select("id", "size", "crc", "split", "copies", F.col("place.at").alias("shard"), F.col("place.next").alias("next"), mixed.alias("mixed")), "shards")
    rows = rows.withColumn("chunk", F.substring("mixed", 1, digits))
    chunks = rows.groupBy("shard", "chunk").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = chunks.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "chunk").orderBy("mixed", F.asc_nulls_first("id"), "size", "crc", "split").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["shard", "chunk"])
    opened = numbered.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    grown = F.when(F.col("next") == shards, F.lit(shards)).otherwise(F.col("shard"))
    return opened.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("inside") + F.col("nth")).alias("slot"), grown.cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", parts: int = 64) -> None:
    """``docs`` as Parquet below ``path``, one folder ``shard=N`` each, by the same law as ``assign``.

    Rows are dealt by shard and a hash of the whole row, so that a shard is written by up to ``parts`` tasks.
    """
    placed = docs.withColumn("shard", jump(stable_key(F.col(f"`{id_col}`")), shards)["at"].cast("int"))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(parts))
    placed.repartition(shards * parts, "shard", spread).write.partitionBy("shard").parquet(path)


def grow_shards(spark, path: str, target: str, shards: int, id_col: str = "doc_id", parts: int = 64) -> None:
    """What must be appended when ``shards`` become one more: the rows of the new shard, from every old one."""
    rows = spark.read.parquet(path).drop("shard")
    moved = rows.filter(jump(stable_key(F.col(f"`{id_col}`")), shards)["next"] == shards)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(parts))
    moved.repartition(parts, spread).write.parquet(f"{target}/shard={shards}")
