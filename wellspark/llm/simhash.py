"""SimHash fingerprints of word shingles, linked by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from wellspark.llm.batches import sized_joins, slices, texts
from wellspark.llm.buckets import cells
from wellspark.llm.components import connected
from wellspark.session import settle

STEP = 100_000


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; 0 without words."""
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        hashes = np.array([digest(join(words), seed)], np.uint64)
    else:
        hashes = np.fromiter((digest(join(t), seed) for t in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a signed long) of every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                values = [fingerprint(t.lower().split(), shingle, seed) for t in texts(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(np.array(values, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())]))


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of all choices of ``blocks - max_bits`` of the blocks: within ``max_bits``, some choice agrees."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, blocks - max_bits)]


def stars(links: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component, for a symmetric boolean matrix."""
    label = np.arange(len(links))
    while True:
        new = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(max_bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            flat = column.flatten()
            fp, part = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("part").to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            across = batch.column("lo").to_numpy() != batch.column("hi").to_numpy()
            left, right = [], []
            for k, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                f = fp[lo:hi]
                links = np.bitwise_count(f[:, None] ^ f[None, :]) <= max_bits
                if across[k]:
                    links &= part[lo:hi, None] != part[None, lo:hi]
                top = stars(links)
                moved = top != np.arange(len(f))
                left.append(f[moved])
                right.append(f[top[moved]])
            a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return work


def hamming_links(fps: DataFrame, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """Edges ``a``, ``b`` that join the different fingerprints of ``fps`` exactly as all pairs within ``max_bits`` do.

    Every choice of ``blocks - max_bits`` blocks is a join key; cells of a key are
    verified by Hamming distance, and each cell gives a spanning forest only.
    """
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in block_masks(blocks, max_bits)])
    keyed = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    return cells(keyed, "key", ["fp"]).mapInArrow(_verify(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, blocks: int = 7, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    A null or empty text has fingerprint zero and links like any other.  Equal
    texts and repeated rows share a fingerprint, which is linked once.  Null ids
    are never a component's id unless it has no other.  An empty table gives no
    rows; other columns of ``docs`` are not read.  Key collisions between blocks
    only add candidates, which the distance check removes.
    """
    each = settle(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    unique = settle(each.groupBy("fp").agg(F.min("id").alias("rep")), "unique")
    # A fingerprint opens to a row for each block key, which the estimate of the table's size leaves out.
    with sized_joins(docs.sparkSession):
        joined = connected(hamming_links(unique, max_bits, blocks))
    labelled = unique.join(joined, F.col("node") == F.col("fp"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return each.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
