"""Order-dependent operators that stay parallel inside one hot key.

A window partitioned by the key alone puts a key with a third of all rows into
one task.  Here every key is cut into chunks of its order column; rows are
numbered, summed or filled inside (key, chunk), and a chunk-level summary, which
is smaller by the chunk length, carries the state from one chunk to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 65536
_CHUNK = "__chunk"
_CARRY = "__carry"


def int_chunk(order: str, size: int = CHUNK_ROWS) -> Column:
    """Chunk id of an integer position."""
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def time_chunk(order: str, seconds: int = 3600) -> Column:
    """Chunk id of a time."""
    return F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(seconds)).cast("long")


def _attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the chunk summary back; keys are matched NULL-safely."""
    left, right = df.alias("l"), summary.alias("r")
    cond = F.lit(True)
    for k in [*keys, _CHUNK]:
        cond = cond & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    extra = [F.col(f"r.`{c}`") for c in summary.columns if c not in keys and c != _CHUNK]
    return left.join(right, cond, "left").select("l.*", *extra)


def _dealt(df: DataFrame, keys: Sequence[str], chunk: Column) -> tuple[DataFrame, list[Column], Column]:
    """``df`` with key and chunk as one struct, and the keys and the chunk taken from it.

    A struct is never NULL and equal to one with NULLs in the same places.  So windows,
    groups and the join of the chunk summary all ask for one partitioning, and the rows move once.
    """
    placed = df.withColumn(_CHUNK, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("c")))
    return placed, [F.col(_CHUNK)[f"k{i}"] for i in range(len(keys))], F.col(_CHUNK)["c"]


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, out: str) -> DataFrame:
    """0-based dense position of each row within its key.

    ``chunk`` must not decrease along ``order``.
    """
    data = df.withColumn(_CHUNK, chunk)
    counts = data.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, _CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_CARRY))
    inside = W.partitionBy(*keys, _CHUNK).orderBy(*order)
    return (
        _attach(data, offsets, keys)
        .withColumn(out, F.col(_CARRY) + F.row_number().over(inside) - F.lit(1))
        .drop(_CHUNK, _CARRY)
    )


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, Column], backward: bool = False
) -> DataFrame:
    """Last known value of each expression up to and including the row.

    ``values`` maps an output column to the expression whose non-NULL values are
    carried.  ``backward`` carries the next known value instead.
    """
    data, of, at_chunk = _dealt(df, keys, chunk)
    for out, expr in values.items():
        data = data.withColumn(f"__v_{out}", expr)
    at = F.struct(*[F.col(o) for o in order])
    pick = F.min_by if backward else F.max_by
    per_chunk = data.groupBy(_CHUNK).agg(
        *[pick(F.col(f"__v_{o}"), F.when(F.col(f"__v_{o}").isNotNull(), at)).alias(f"__c_{o}") for o in values]
    )
    # Backward runs forward over the reversed order: a frame to the end of a partition is worked out anew for every row.
    along = [F.col(o).desc() if backward else F.col(o).asc() for o in order]
    chunks = at_chunk.desc() if backward else at_chunk.asc()
    elsewhere = W.partitionBy(*of).orderBy(chunks).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(_CHUNK).orderBy(*along).rowsBetween(W.unboundedPreceding, 0)
    take = F.last
    carried = per_chunk.select(
        _CHUNK, *[take(f"__c_{o}", ignorenulls=True).over(elsewhere).alias(f"__k_{o}") for o in values]
    )
    joined = data.join(carried, _CHUNK, "left")
    for out in values:
        joined = joined.withColumn(
            out, F.coalesce(take(f"__v_{out}", ignorenulls=True).over(inside), F.col(f"__k_{out}"))
        )
    drop = [_CHUNK] + [f"__{p}_{o}" for o in values for p in "vk"]
    return joined.drop(*drop)


def count_since_reset(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, counted: Column, reset: Column, out: str
) -> DataFrame:
    """Running count of ``counted`` rows since the last ``reset`` row of the key.

    A reset row itself counts 0.  ``counted`` and ``reset`` never hold together.
    """
    data = df.withColumn(_CHUNK, chunk).withColumn("__f", counted.cast("long")).withColumn("__s", reset.cast("long"))
    inside = W.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    data = data.withColumn("__g", F.sum("__s").over(inside))
    # Per chunk: how many resets, and how many counted rows follow the last one.
    tails = data.groupBy(*keys, _CHUNK, "__g").agg(F.sum("__f").alias("__n"))
    summary = tails.groupBy(*keys, _CHUNK).agg(
        F.max("__g").alias("__resets"), F.max_by("__n", "__g").alias("__tail")
    )
    upto = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, 0)
    summary = summary.withColumn("__total", F.sum("__resets").over(upto))
    run = W.partitionBy(*keys, "__total").orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, 0)
    by_key = W.partitionBy(*keys).orderBy(_CHUNK)
    summary = summary.withColumn("__run", F.sum("__tail").over(run)).select(
        *keys, _CHUNK, F.coalesce(F.lag("__run").over(by_key), F.lit(0)).alias(_CARRY)
    )
    in_group = W.partitionBy(*keys, _CHUNK, "__g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        _attach(data, summary, keys)
        .withColumn(out, F.sum("__f").over(in_group) + F.when(F.col("__g") == 0, F.col(_CARRY)).otherwise(F.lit(0)))
        .drop(_CHUNK, _CARRY, "__f", "__s", "__g")
    )


def sessionize(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap_seconds: int, chunk_seconds: int = 3600) -> DataFrame:
    """Activity sessions: a row starts one when nothing happened in the gap before it.

    The previous time comes from the same chunk, or from the last earlier chunk;
    sessions are then summed with partial aggregation, never collected.
    """
    data = df.select(*keys, at, tie).withColumn(_CHUNK, time_chunk(at, chunk_seconds))
    ends = data.groupBy(*keys, _CHUNK).agg(F.max(at).alias("__last"))
    before = W.partitionBy(*keys).orderBy(_CHUNK)
    carried = ends.select(*keys, _CHUNK, F.lag("__last").over(before).alias(_CARRY))
    inside = W.partitionBy(*keys, _CHUNK).orderBy(at, tie)
    previous = F.coalesce(F.lag(at).over(inside), F.col(_CARRY))
    silent = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))
    marked = _attach(data, carried, keys).withColumn("__start", F.when(previous.isNull() | (silent >= gap_seconds * 1_000_000), F.col(at)))
    filled = fill_forward(marked.drop(_CHUNK, _CARRY), keys, [at, tie], time_chunk(at, chunk_seconds), {"created_at": F.col("__start")})
    return filled.groupBy(*keys, "created_at").agg(F.max(at).alias("last_activity"), F.count(F.lit(1)).alias("n_events"))


def _xor(a: Column, b: Column) -> Column:
    return (a + b) % F.lit(2)


def scan_two_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, from0: Column, from1: Column, out: str) -> DataFrame:
    """``out_before`` and ``out_after``: the state, 0 or 1, before and after each row, and ``out_end`` after the key's last row.

    ``from0`` and ``from1`` tell where a row leads from either state; every key
    starts in 0.  A row keeps the state, swaps it, or sets it whatever it was.  So
    each chunk is read for both starts at once: the state is the last value that
    was set, turned by the swaps since then, and only without one does the
    chunk's own start count.  Chunks are composed in the same way.
    """
    after, before = f"{out}_after", f"{out}_before"
    data, of, at_chunk = _dealt(df, keys, chunk)
    data = data.withColumn("__0", from0.cast("int")).withColumn("__1", from1.cast("int"))
    swaps, sets = (F.col("__0") > F.col("__1")).cast("int"), F.col("__0") == F.col("__1")
    inside = W.partitionBy(_CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    data = data.withColumn("__s", F.sum(swaps).over(inside))
    data = data.withColumn("__k", F.last(F.when(sets, F.struct(F.col("__0").alias("v"), F.col("__s").alias("s"))), ignorenulls=True).over(inside))
    at = F.struct(*[F.col(o) for o in order])
    ends = data.groupBy(_CHUNK).agg(F.max_by(F.struct("__s", "__k"), at).alias("e"))
    turned = F.when(F.col("e.__k").isNotNull(), _xor(F.col("e.__k.v"), F.col("e.__s") - F.col("e.__k.s")))
    ends = ends.select(_CHUNK, turned.alias("__v"), F.when(turned.isNull(), F.col("e.__s") % 2).otherwise(0).alias("__w"))
    upto = W.partitionBy(*of).orderBy(at_chunk).rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumn("__s", F.sum("__w").over(upto))
    ends = ends.withColumn("__k", F.last(F.when(F.col("__v").isNotNull(), F.struct(F.col("__v").alias("v"), F.col("__s").alias("s"))), ignorenulls=True).over(upto))
    ends = ends.withColumn("__a", F.when(F.col("__k").isNotNull(), _xor(F.col("__k.v"), F.col("__s") - F.col("__k.s"))).otherwise(F.col("__s") % 2))
    whole = W.partitionBy(*of).orderBy(at_chunk)
    last = F.last("__a").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    carried = ends.select(_CHUNK, F.coalesce(F.lag("__a").over(whole), F.lit(0)).alias(_CARRY), last.cast("int").alias(f"{out}_end"))
    state = F.when(F.col("__k").isNotNull(), _xor(F.col("__k.v"), F.col("__s") - F.col("__k.s"))).otherwise(_xor(F.col(_CARRY), F.col("__s")))
    joined = data.join(carried, _CHUNK, "left").withColumn(after, state.cast("int"))
    previous = F.lag(after).over(W.partitionBy(_CHUNK).orderBy(*order))
    return joined.withColumn(before, F.coalesce(previous, F.col(_CARRY)).cast("int")).drop(_CHUNK, _CARRY, "__0", "__1", "__s", "__k")


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, out: str) -> DataFrame:
    """The value of the row before, also where that row lies in an earlier chunk; NULL for a key's first row."""
    data = df.withColumn(_CHUNK, chunk)
    ends = data.groupBy(*keys, _CHUNK).agg(F.max_by(value, F.struct(*[F.col(o) for o in order])).alias("__last"))
    carried = ends.select(*keys, _CHUNK, F.lag("__last").over(W.partitionBy(*keys).orderBy(_CHUNK)).alias(_CARRY))
    inside = F.lag(value).over(W.partitionBy(*keys, _CHUNK).orderBy(*order))
    return _attach(data, carried, keys).withColumn(out, F.coalesce(inside, F.col(_CARRY))).drop(_CHUNK, _CARRY)
