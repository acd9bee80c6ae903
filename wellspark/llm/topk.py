"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wellspark.llm.batches import batch_rows
from wellspark.session import settle

#: Documents in a block and blocks in a group.
BLOCK, GROUP = 128, 64
#: Groups of a partition make columns: one for each group while there are few, then about this many, of so many bytes of longs at most.
COLUMNS, COLUMN_BYTES = 64, 64_000_000
#: Queries searched for at once, and rows of groups or queries handed to Python at once.
ASKED, ROWS = 1024, 4
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53
NO_FLOOR = -(1 << 63)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows as longs, short ones filled up with zeros, which leaves inner products as they are."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _stacked(matrices: list[np.ndarray]) -> np.ndarray:
    width = max(m.shape[1] for m in matrices)
    return np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices])


def _narrow(m: np.ndarray) -> bytes:
    """The numbers in the fewest of 2, 4 or 8 bytes each that hold them all."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _packed(size: int):
    """Runs of ``size`` rows of a sorted partition as one row each, numbered within their partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        ids, vectors = np.zeros(0, np.int64), np.zeros((0, 0), np.int64)

        def row(n: int) -> pa.RecordBatch:
            columns = pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([ids[:n].tobytes()]), pa.array([_narrow(vectors[:n])]), pa.array([vectors.shape[1]], pa.int32())
            return pa.RecordBatch.from_arrays(list(columns), ["part", "nth", "ids", "vectors", "dim"])

        for batch in batches:
            ids = np.concatenate([ids, batch.column("id").to_numpy(zero_copy_only=False)])
            vectors = _stacked([vectors, _matrix(batch.column("vector"))])
            while len(ids) >= size:
                yield row(size)
                ids, vectors, nth = ids[size:], vectors[size:], nth + 1
        if len(ids):
            yield row(len(ids))

    return work


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    each = len(vectors) // (len(i) * dim) if dim else 8
    return i, np.frombuffer(vectors, f"i{each}").reshape(len(i), dim)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as wide as the wider one, as doubles if every sum of products is exact in them, else as longs."""
    d = max(a.shape[1], b.shape[1])
    peak = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b)]
    kind = np.float64 if peak[0] * peak[1] * d < EXACT else np.int64
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))).astype(kind) for x in (a, b))


def block_search(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floors: dict[int, int], block: int = BLOCK) -> tuple[np.ndarray, int]:
    """The k best (query, id, score) among these documents per query, and the number of blocks scored.

    A term is a dimension with a sign.  A block's bound is the sum, over the
    query's terms, of the query's weight times the block's largest weight.
    Blocks are visited from the highest bound; those below the kth score, or
    below the floor a query brings along, are not scored.  A query visits 1, 2, 4
    and so on of its blocks between two looks at its kth score, so that a block is
    scored for all queries whose turn it is by one product.
    """
    queries, vectors = _same_width(queries, vectors)
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, 1)
    limit = np.array([floors.get(int(q), NO_FLOOR) for q in qids], np.int64).astype(vectors.dtype)
    best_q, best_i, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
    live, at, wide, scored = np.arange(len(qids)), 0, 1, 0
    while at < len(starts) and len(live := live[bounds[live, at] >= limit[live]]):
        turn, place = np.nonzero(bounds[live, at : at + wide] >= limit[live, None])
        asked, met = live[turn], order[live[turn], at + place]
        scored += len(met)
        by_block = np.argsort(met, kind="stable")
        ends = np.searchsorted(met[by_block], np.arange(len(starts) + 1))
        more_q, more_i, more_s = [best_q], [best_i], [best_s]
        for b in np.flatnonzero(np.diff(ends)):
            q, own = asked[by_block[ends[b] : ends[b + 1]]], slice(starts[b], starts[b] + block)
            scores = queries[q] @ vectors[own].T
            i, j = np.nonzero((scores >= limit[q, None]) & (ids[own] != qids[q, None]))
            more_q.append(q[i])
            more_i.append(ids[own][j])
            more_s.append(scores[i, j])
        best_q, best_i, best_s = map(np.concatenate, (more_q, more_i, more_s))
        by_rank = np.lexsort((best_i, -best_s, best_q))
        best_q, best_i, best_s = best_q[by_rank], best_i[by_rank], best_s[by_rank]
        rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
        kth = rank == k - 1
        limit[best_q[kth]] = np.maximum(limit[best_q[kth]], best_s[kth])
        best_q, best_i, best_s = (x[rank < k] for x in (best_q, best_i, best_s))
        at, wide = at + wide, 2 * wide
    return np.stack([qids[best_q], best_i, best_s.astype(np.int64)], axis=1), scored


def _home(every: int, k: int, block: int):
    """The queries of a group as rows, with a floor for each kth score from the group itself (the least long without one)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors = _unpack(*(batch.column(c)[i].as_py() for c in ("ids", "vectors", "dim")))
                asking = np.flatnonzero(ids % every == 0)
                for lo in range(0, len(asking), ASKED):
                    own = asking[lo : lo + ASKED]
                    found, _ = block_search(ids[own], vectors[own], ids, vectors, k, {}, block)
                    order = np.argsort(ids[own])
                    places = order[np.searchsorted(ids[own], found[:, 0], sorter=order)]
                    floors = np.full(len(own), np.iinfo(np.int64).max)
                    np.minimum.at(floors, places, found[:, 2])
                    floors[np.bincount(places, minlength=len(own)) < k] = NO_FLOOR
                    columns = pa.array([ids[own].tobytes()]), pa.array([_narrow(vectors[own])]), pa.array([vectors.shape[1]], pa.int32()), pa.array([floors.tobytes()])
                    yield pa.RecordBatch.from_arrays(list(columns), ["ids", "vectors", "dim", "floors"])

    return work


def _search(k: int, block: int):
    """The best of each column for each query: a partition holds, column by column, first its groups, then all queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, groups, asked = None, [], []

        def searched() -> pa.RecordBatch:
            ids, vectors = np.concatenate([i for i, _ in groups]), _stacked([v for _, v in groups])
            qids, queries = np.concatenate([i for i, _, _ in asked]), _stacked([v for _, v, _ in asked])
            floors = {q: f for i, _, own in asked for q, f in zip(i.tolist(), own.tolist()) if f != NO_FLOOR}
            found, _ = block_search(qids, queries, ids, vectors, k, floors, block)
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, n]) for n in range(3)], ["query_id", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["at"] != column:
                    if asked:
                        yield searched()
                    column, groups = row["at"], []
                packed = _unpack(row["ids"], row["vectors"], row["dim"])
                if row["floors"] is None:
                    groups.append(packed)
                    continue
                asked.append((*packed, np.frombuffer(row["floors"], np.int64)))
                if sum(len(a[0]) for a in asked) >= ASKED:
                    yield searched()
        if asked:
            yield searched()

    return work


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``query_id``, ``rank``, id, ``score`` of the k best inner products of each query row with every other row.

    Components become floor(scale * x).  Queries are the rows whose id ``every``
    divides.  Ties go to the smaller id.  Rows are put in order of their strongest
    dimension, so that a block holds neighbours, and packed into groups of
    ``group`` blocks.  Each query first searches its own group, which gives a
    floor for its kth score.  Then neighbouring groups make columns, and all queries
    meet every column: a shuffle brings a column's groups into one task once, the
    queries follow them there as a stream, and blocks below the floor or the kth
    score so far are not scored.  A column gives at most k rows per query.

    Vectors that are null or hold a null or non-finite component, and rows
    without id, take no part.  Rows that repeat an id count once, with the
    smallest vector.  A short vector counts as filled up with zeros.  Scores must
    fit a long.  With fewer than k others all are returned; an empty table gives
    no rows; other columns are not read.
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & F.coalesce(~bad, F.lit(False)))
    whole = clean.groupBy("id").agg(F.min("vector").alias("vector")).select("id", F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("vector"))
    size = F.transform(v, lambda x: F.abs(x))
    peak = F.array_position(size, F.array_max(size)).cast("int")
    ready = whole.withColumn("spot", F.when(F.size("vector") > 0, F.struct(peak.alias("dim"), F.element_at(v, peak).alias("x"))))
    ordered = ready.repartitionByRange("spot", "id").sortWithinPartitions("spot", "id").select("id", "vector")
    spark = rows.sparkSession
    groups = settle(ordered.mapInArrow(_packed(block * group), "part int, nth int, ids binary, vectors binary, dim int"), "groups")
    with batch_rows(spark, ROWS):
        homes = settle(groups.mapInArrow(_home(every, k, block), "ids binary, vectors binary, dim int, floors binary"), "queries")
        n, largest = groups.agg(F.count("*"), F.max(F.length("ids") * F.col("dim").cast("long"))).first()
        run = max(1, min(math.ceil(n / COLUMNS), COLUMN_BYTES // max(1, largest or 0)))
        dealt = groups.withColumn("at", F.shiftleft(F.col("part").cast("long"), 32) + F.floor(F.col("nth") / run)).select("at", "ids", "vectors", "dim", F.lit(None).cast("binary").alias("floors"))
        columns = [r["at"] for r in dealt.select("at").distinct().collect()]
        # No join: the queries of one group are few bytes, but open to a row for each column, which Spark would take for small and broadcast.
        asked = homes.withColumn("at", F.explode(F.lit(np.array(columns, np.int64)))).select(*dealt.columns)
        met = dealt.unionByName(asked).repartition(max(1, len(columns)), "at").sortWithinPartitions("at", F.col("floors").isNotNull())
        found = met.mapInArrow(_search(k, block), "query_id long, id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return settle(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"), "best")
