"""Ranked lexical search over a length-stratified index."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wellspark.llm.batches import slices, texts
from wellspark.session import settle

#: Documents of a block, and the most blocks that the corpus alone calls for: beyond that, blocks grow.
DOCS, BLOCKS = 1024, 1_000_000
#: Postings of a block.
POSTINGS = 200_000
#: Bits of the filter that keeps only terms some item may ask for; its size is fixed, the join on the term itself is exact.
FILTER_BITS = 1 << 22
#: Items that meet a block in one row, and how many times more strata each round visits.
ITEMS, WIDER = 64, 16

#: ASCII letters and digits stay, capitals become small, other ASCII ends a term; everything above is a term's character.
_TABLE = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _bags(bits: np.ndarray | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                n, ends, words, times = [], [0], [], []
                for text in texts(piece.column("text")):
                    found = terms_of(text)
                    bag = Counter(found)
                    kept = bag.items() if bits is None else [x for x in bag.items() if bits[zlib.crc32(x[0]) % FILTER_BITS]]
                    for term, tf in kept:
                        words.append(term)
                        times.append(tf)
                    n.append(len(found))
                    ends.append(len(words))
                at = pa.array(ends, pa.int32())
                columns = [piece.column("id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(words, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tfs"])

    return work


def bags(rows: DataFrame, id_col: str, text_col: str, bits: np.ndarray | None = None) -> DataFrame:
    """``id``, ``n`` (terms with repeats), ``terms`` and ``tfs`` of every row; of the terms those that pass the filter."""
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_bags(bits), "id long, n long, terms array<string>, tfs array<long>")


def vocabulary_filter(terms: DataFrame) -> np.ndarray:
    """A byte per hash value: whether a term of ``terms`` has it.  The driver gets at most ``FILTER_BITS`` bits."""
    hashed = terms.select((F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS)) + 1).alias("h"))
    parts = hashed.groupBy(F.bitmap_bucket_number("h").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS, np.uint8)
    for r in parts:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        out[(r["at"] - 1) * len(bits) : r["at"] * len(bits)] = bits
    return out


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One block: per term its postings, those of equal tf together, highest tf first."""
    table = table.combine_chunks()
    m, part = (k.as_py() for k in key)
    lists = table.column("terms").combine_chunks()
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    tf = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(table.num_rows, dtype=np.int64), counts)
    term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((doc, -tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    change = np.ones(len(term), bool)
    change[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
    runs = np.flatnonzero(change)
    first = np.searchsorted(term[runs], np.arange(len(words.dictionary) + 1))
    tops = tf[runs[first[:-1]]]
    df = np.diff(np.r_[runs, len(term)][first]) if len(runs) else np.zeros(0, np.int64)
    one = {
        "block": pa.array([(m << 32) + part], pa.int64()), "m": pa.array([m], pa.int64()), "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
        "terms": pa.array([words.dictionary.to_pylist()], pa.list_(pa.string())), "tops": pa.array([tops.tolist()], pa.list_(pa.int64())), "dfs": pa.array([df.tolist()], pa.list_(pa.int64())),
        "first": pa.array([first.astype(np.int32).tobytes()]), "runs": pa.array([np.r_[runs, len(term)].astype(np.int32).tobytes()]),
        "tfs": pa.array([tf[runs].astype(np.int64).tobytes()]), "docs": pa.array([doc.astype(np.int32).tobytes()]),
    }
    return pa.table(one)


BLOCK_SCHEMA = "block long, m long, ids array<long>, terms array<string>, tops array<long>, dfs array<long>, first binary, runs binary, tfs binary, docs binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: np.ndarray | None = None) -> tuple[DataFrame, int]:
    """The index as a written table of blocks, and the number of documents that hold a term.

    A stratum is all documents of one normaliser m; it is cut by a row's place in
    the written bags into blocks of about ``DOCS`` documents or ``POSTINGS``
    postings.  Within a block, a term's postings lie by falling tf.  With ``bits``
    the index holds only terms that pass the filter.
    """
    each = settle(bags(docs, id_col, text_col, bits).filter("n > 0").withColumn("place", F.monotonically_increasing_id()), "bags")
    n, words = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = each.withColumn("m", F.lit(50).cast("long") + F.expr(f"(50 * n * {n}L) div {max(1, words)}L"))
    most = max(DOCS, n // BLOCKS)
    wanted = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum(F.size("terms")) / (POSTINGS * (most // DOCS))))
    parts = held.groupBy("m").agg(wanted.cast("int").alias("parts"))
    dealt = held.join(parts, "m").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int")).select("m", "part", "id", "terms", "tfs")
    # Dealt by both columns: a large stratum must not stay where the join by m has put it.
    return settle(dealt.repartition("m", "part").groupBy("m", "part").applyInArrow(_block, BLOCK_SCHEMA), "blocks"), n


def gain(tf: np.ndarray, m: int) -> np.ndarray:
    """Impact of a tf in a stratum, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def score_block(m: int, ids: np.ndarray, index: dict[str, int], first: np.ndarray, runs: np.ndarray, tfs: np.ndarray, docs: np.ndarray, asked: list[tuple[list[str], list[int], int]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each (terms, weights, floor) the k best places and scores at or above the floor, and how many were scored at all.

    An impact is computed once for each tf.  An item whose bound in this block is below its floor is passed over.
    """
    per_run = gain(tfs, m)
    per_posting = np.repeat(per_run, np.diff(runs))
    out, scored = [], 0
    nothing = np.zeros(0, np.int64)
    for terms, weights, floor in asked:
        known = [(index[t], w) for t, w in zip(terms, weights) if t in index]
        at, w = np.array([x[0] for x in known], np.int64), np.array([x[1] for x in known], np.int64)
        if not len(at) or int((w * per_run[first[at]]).sum()) < floor:
            out.append((nothing, nothing))
            continue
        scored += 1
        lo, hi = runs[first[at]].astype(np.int64), runs[first[at + 1]].astype(np.int64)
        length = hi - lo
        where = np.arange(length.sum()) + np.repeat(lo - (np.cumsum(length) - length), length)
        score = np.zeros(len(ids), np.int64)
        np.add.at(score, docs[where], per_posting[where] * np.repeat(w, length))
        take = np.flatnonzero(score >= floor)
        best = take[np.lexsort((ids[take], -score[take]))[:k]]
        out.append((best, score[best]))
    return out, scored


def _visit(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                own = row["ids"].values
                ids = own.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                first, runs, docs = (np.frombuffer(row[c].as_py(), np.int32) for c in ("first", "runs", "docs"))
                index = {t: j for j, t in enumerate(row["terms"].as_py())}
                asked = row["asked"].as_py()
                found, _ = score_block(row["m"].as_py(), ids, index, first, runs, np.frombuffer(row["tfs"].as_py(), np.int64), docs, [(a["terms"], a["weights"], a["floor"]) for a in asked], k)
                item = pa.array([a["item_id"] for a in asked], pa.int64()).take(pa.array(np.repeat(np.arange(len(asked)), [len(f[0]) for f in found])))
                places, scores = (np.concatenate([f[j] for f in found]) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([item, own.take(pa.array(places)), pa.array(scores, pa.int64())], ["item_id", "id", "score"])

    return work


def search(blocks: DataFrame, n: int, asked: DataFrame, k: int = 50) -> DataFrame:
    """``item_id``, ``rank``, ``id``, ``score``: the k best documents of the index for every item of ``asked`` (``item_id``, ``term``, each once).

    A stratum's bound for an item sums the impacts of its largest tf of each term.
    Each item visits the strata from the highest bound on, in rounds that widen
    ``WIDER`` times; after each round its kth score is a floor, and strata and
    blocks whose bound lies below it are not visited any more.
    """
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1)))
    df = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    weighted = settle(asked.join(df.select("term", weight.alias("w")), "term"), "weights")
    tops = blocks.select("m", F.explode(F.arrays_zip("terms", "tops")).alias("x")).groupBy("m", F.col("x.terms").alias("term")).agg(F.max("x.tops").alias("top"))
    impact = F.expr("w * ((1000000000 * top) div (1000 * top + 20 * m))")
    bounds = weighted.join(tops, "term").groupBy("item_id", "m").agg(F.sum(impact).alias("bound")).filter("bound > 0")
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "m"))
    visits = settle(bounds.withColumn("nth", nth), "visits")
    last = visits.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0]
    chunks = weighted.select("item_id").distinct().count() // ITEMS + 1
    items = weighted.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights")).withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)))
    items, places = settle(items, "items"), blocks.select("block", "m")
    best, done, wide = None, 0, WIDER
    open_ = visits.withColumn("floor", F.lit(1).cast("long"))
    top = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    while best is None or done < last:
        todo = open_.filter((F.col("nth") > done) & (F.col("nth") <= done + wide)).join(items, visits["item_id"].eqNullSafe(items["item_id"])).drop(items["item_id"])
        met = todo.groupBy("m", "chunk").agg(F.collect_list(F.struct("item_id", "terms", "weights", "floor")).alias("asked"))
        found = blocks.drop("tops", "dfs", "m").join(met.join(places, "m"), "block").mapInArrow(_visit(k), "item_id long, id long, score long")
        found = found if best is None else found.unionByName(best.select("item_id", "id", "score"))
        best = settle(found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k), "best")
        done, wide = done + wide, wide * WIDER
        floors = best.groupBy(F.col("item_id").alias("_item")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(1).alias("floor"))
        open_ = visits.join(floors, F.col("item_id").eqNullSafe(F.col("_item")), "left").withColumn("floor", F.coalesce("floor", F.lit(1))).drop("_item").filter("bound >= floor")
        last = open_.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0]
    return best


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 50) -> DataFrame:
    """``item_id``, ``rank``, the document's id, ``score`` for the k best documents of every item, scores above 0.

    Every row of ``docs`` is a document, repeated rows too; null and empty texts
    hold no term and count nowhere.  Rows of one item id are one item with the
    terms of all of them; null is an id.  Equal scores by ascending id, null first.
    Items or documents without terms give no rows, as empty tables do; other columns are not read.
    """
    asked = settle(bags(items, item_col, item_text).select(F.col("id").alias("item_id"), F.explode("terms").alias("term")).distinct(), "asked")
    blocks, n = build_index(docs, id_col, text_col, vocabulary_filter(asked))
    found = search(blocks, n, asked, k)
    return found.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
