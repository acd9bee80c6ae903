"""Arrow columns as flat byte arrays, cut into slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

SLICE_BYTES = 2_000_000

#: One word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows to an Arrow batch for jobs run inside, whose rows are large; the session's own limit if that is less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def sized_joins(spark: SparkSession) -> Iterator[None]:
    """Tables are broadcast by the size they are found to have, not by an estimate: a few bytes may open to very many rows."""
    known, found = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, own = spark.conf.get(known), spark.conf.get(found, None)
    spark.conf.set(found, own or before)
    spark.conf.set(known, "-1")
    try:
        yield
    finally:
        spark.conf.set(known, before)
        spark.conf.unset(found) if own is None else spark.conf.set(found, own)


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 offsets; a null text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(column) else whole[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    _, offsets = flat_utf8(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def learned_apart(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
