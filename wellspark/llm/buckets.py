"""Comparing the members of buckets without one task ever holding a large bucket.

A bucket of n members is cut by a hash into c = ceil(n / size) parts; each pair of
parts is a cell of at most about 2 * size members, so a hot bucket spreads over
c * (c + 1) / 2 cells.  Cells of one member are dropped; all buckets take this path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CELL = 512


def cells(members: DataFrame, key: str, value: list[str], size: int = CELL) -> DataFrame:
    """``key``, ``lo``, ``hi`` and ``members``: an array of structs of ``value`` and ``part``.

    ``members`` must hold a value at most once in a bucket.  With lo = hi all pairs
    of the cell are meant, otherwise the pairs between part lo and part hi.
    """
    counts = members.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.ceil(F.col("_n") / size).cast("int").alias("_c"))
    own = F.pmod(F.xxhash64(*value), F.col("_c")).cast("int")
    dealt = members.join(counts, key).withColumn("part", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    grouped = dealt.groupBy(key, F.least("part", "_other").alias("lo"), F.greatest("part", "_other").alias("hi")).agg(F.collect_list(F.struct(*value, "part")).alias("members"))
    return grouped.filter(F.size("members") > 1)
