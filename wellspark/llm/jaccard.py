"""Near copies by the Jaccard similarity of word shingles: SimHash for close pairs, MinHash bands for the rest, exact sets to decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wellspark.llm.batches import batch_rows, sized_joins, slices, texts
from wellspark.llm.buckets import cells
from wellspark.llm.components import connected, contract
from wellspark.llm.simhash import hamming_links, majority, stars
from wellspark.session import settle

#: A pair at 0.8 shares one of 30 bands of 6 with probability 0.9999, a pair at 0.5 with 0.38.
BANDS, WIDTH = 30, 6
#: Texts of a cell that are compared with each other, about twice this number.
CELL = 64
#: What a product may be off by.
NEAR_NOTHING = 1e-9
#: Rounds go on while one comparison of so many links something.
WORTH = 8
#: Up to this many texts of a cell are compared pair by pair, each pair once for all cells.
FEW = 32
#: Pairs of texts, and cells of up to twice ``CELL`` texts, that a batch brings to Python.
PAIR_ROWS, CELL_ROWS = 100, 8
STEP = 4_000
COLUMNS = 32_768


def shingles(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the different runs of ``shingle`` words; all words of a shorter text, none of an empty one."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return np.array([digest(join(words), seed)], np.uint64)
    return np.unique(np.fromiter((digest(join(t), seed) for t in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1))


def _name(found: np.ndarray) -> int:
    """Texts of equal sets have one name."""
    return xxhash.xxh64_intdigest(found.tobytes(), 1)


def _bands(found: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """A key per band; none without words."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), STEP):
        x = factor[:, None] * found[None, i : i + STEP]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(axis=1), out=least)
    rows = least.reshape(BANDS, WIDTH)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), t) for t, r in enumerate(rows)], np.uint64).view(np.int64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


#: A task hands on a text's hashes when it meets the name first; it remembers this many names at a time.
NAMES = 200_000
MASK = np.uint64((1 << 48) - 1)


def pack(found: np.ndarray) -> bytes:
    """Hashes cut to 48 bits, sorted, six bytes each."""
    return np.unique(found & MASK).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    six = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (0, 2))).reshape(-1).view("<u8")


def _signatures(shingle: int):
    factor = np.random.default_rng(11).integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch, "text"):
                names, prints, keys, packed = [], [], [], []
                for t in texts(piece.column("text")):
                    found = shingles(t, shingle)
                    name = _name(found)
                    names.append(name)
                    prints.append(majority(found))
                    keys.append(_bands(found, factor))
                    packed.append(None if name in seen else pack(found))
                    if len(seen) >= NAMES:
                        seen.clear()
                    seen.add(name)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("own"), _signed(names), _signed(prints), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["id", "own", "uid", "fp", "keys", "packed"])

    return work


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared)


def _edges(least: float):
    """Edges whose two texts are alike; the centre's set is unpacked once for edges in a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, None
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x"), batch.column("y")):
                if centre != b:
                    centre, held = b, unpack(y.as_py())
                if _alike(unpack(x.as_py()), held, least):
                    keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], ["a", "b"])

    return work


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every hash of every text."""
    for batch in batches:
        for uid, component, packed in zip(batch.column("uid").to_pylist(), batch.column("component").to_pylist(), batch.column("packed")):
            found = unpack(packed.as_py()).astype(np.int64)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                columns = [pa.array(np.full(len(part), x, np.int64)) for x in (uid, component, len(found))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(part)], ["uid", "component", "size", "gram"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles that each two sets share, through blocks of columns of bounded size."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    more = n > 1
    renumbered = np.cumsum(more) - 1
    mine = more[column]
    owner, column = owner[mine], renumbered[column[mine]]
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(more.sum()), COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[i:j], column[i:j] - lo] = 1
        total += block @ block.T
    return total


def _cells(least: float):
    """Edges between components that alike texts of the cells join: a spanning forest of them for each task.

    What is known to be linked gives no edge, so components that meet in many cells
    give no more edges than there are components, whatever the number of their texts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for lo, hi, members in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), batch.column("members")):
                component, part, packed = (members.values.field(c) for c in ("component", "part", "packed"))
                part = part.to_numpy()
                sets = [unpack(x.as_py()) for x in packed]
                size = np.array([len(s) for s in sets])
                shared = shared_counts(sets)
                links = shared >= least * (size[:, None] + size[None, :] - shared)
                if lo != hi:
                    links &= part[:, None] != part[None, :]
                names, place = np.unique(component.to_numpy(), return_inverse=True)
                i, j = np.nonzero(links)
                joined = np.zeros((len(names), len(names)), bool)
                joined[place[i], place[j]] = True
                top = stars(joined)
                moved = top != np.arange(len(names))
                left.append(names[moved])
                right.append(names[top[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (left, right)], ["a", "b"])

    return lambda batches: contract(work(batches))


def _checked(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose texts are alike."""
    both = pairs.join(held.select(F.col("uid").alias("a"), F.col("packed").alias("x")), "a").join(held.select(F.col("uid").alias("b"), F.col("packed").alias("y")), "b")
    with batch_rows(held.sparkSession, PAIR_ROWS):
        return settle(both.select("a", "b", "x", "y").mapInArrow(_edges(least), "a long, b long"), "links")


def _close(prints: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of texts that join those of ``prints`` (``uid``, ``fp``) whose SimHash fingerprints are linked.

    Texts of one fingerprint are paired with its smallest, and these along the
    edges that join all fingerprints within a few bits.
    """
    first = settle(prints.groupBy("fp").agg(F.min("uid").alias("b"), F.count("*").alias("n")), "fingerprints")
    equal = prints.join(first.filter("n > 1"), "fp").filter("uid <> b").select(F.col("uid").alias("a"), "b")
    with sized_joins(prints.sparkSession):
        edges = settle(hamming_links(first.select("fp")).distinct(), "fingerprint-links")
    ends = [first.select(F.col("fp").alias(c), F.col("b").alias(f"uid_{c}")) for c in ("a", "b")]
    across = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b"))
    return settle(equal.unionByName(across), "close-pairs")


def _links(each: DataFrame, keyed: DataFrame, close: DataFrame, least: float) -> DataFrame:
    """Edges that join texts exactly as all alike pairs do that share a band.

    The pairs that SimHash brings together (``close``) are decided first.  Then one
    text of each component in a bucket is compared with the bucket's smallest, and
    one text of each component left in an open bucket is compared with one of
    them, picked anew, as long as a good part of the comparisons links something.
    What is then still apart goes through ``_apart``.  No step brings a text's
    hashes together with more than one other text for each bucket and round.
    """
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = settle(keyed.join(buckets, "key"), "buckets")
    candidates = members.select("uid").union(close.select("a")).union(close.select("b")).distinct()
    # A task hands on a text's hashes once, so very many copies do not meet in one task of this join.
    held = settle(each.filter("packed is not null").select("uid", "packed").join(candidates, "uid", "left_semi").dropDuplicates(["uid"]), "candidates")
    joined = connected(_checked(close, held, least))
    grouped = members.select("key", "uid").join(joined.withColumnRenamed("node", "uid"), "uid", "left")
    one = settle(grouped.groupBy("key", F.coalesce("component", "uid").alias("component")).agg(F.min("uid").alias("a")), "representatives")
    smallest = one.groupBy("key").agg(F.min("a").alias("b"))
    joined = connected(_stars(joined).unionByName(_checked(one.join(smallest, "key").filter("a <> b").select("a", "b").distinct(), held, least)))
    found = _stars(joined)

    several = members.filter("n > 2").select("key", "uid")
    named = _named(several.select("uid").distinct(), joined)
    one = several.join(named, "uid").groupBy("key", "component").agg(F.min("uid").alias("a"))
    turn = 0
    while True:
        one = settle(one, "representatives")
        open_keys = one.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        one = settle(one.join(open_keys, "key", "left_semi"), "open-buckets")
        centre = one.groupBy("key").agg(F.min_by("a", F.xxhash64(F.lit(turn), "component")).alias("b"))
        pairs = settle(one.join(centre, "key").filter("a <> b").select("a", "b").distinct(), "pairs")
        more = _checked(pairs, held, least)
        linked, compared = more.count(), pairs.count()
        found = found.unionByName(more) if linked else found
        if linked * WORTH <= compared:
            break
        # Components only grow together, so closed buckets stay closed and labels are mapped on.
        merged = connected(more.unionByName(one.select("a", F.col("component").alias("b")).distinct()))
        one = one.join(merged.withColumnRenamed("component", "now"), F.col("component") == F.col("node"), "left").groupBy("key", F.coalesce("now", "component").alias("component")).agg(F.min("a").alias("a"))
        turn += 1
    open_texts = several.join(one.select("key").distinct(), "key", "left_semi").select("uid").distinct()
    joined = connected(found)
    return _stars(joined).unionByName(_apart(settle(_named(open_texts, joined), "open-texts"), held, least))


def _stars(components: DataFrame) -> DataFrame:
    """Components as edges: one for each text, in place of all edges that led to them."""
    return components.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _named(uids: DataFrame, components: DataFrame) -> DataFrame:
    """``uid``, ``component`` of ``uids``; a text without links is its own component."""
    return uids.join(components.withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("component", "uid").alias("component"))


def _apart(open_texts: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Edges between different components of ``open_texts`` (``uid``, ``component``), by prefix filter; exact.

    Only hashes that two components share can make a pair.  Texts of s and r hashes
    that are alike share c = least / (1 + least) * (s + r) of them, and so one of any
    s - c + 1 and r - c + 1; of these the ones no other component has go first, then
    the rarest.  So a text whose own part is larger than that sends nothing.
    """
    texts_ = open_texts.join(held, "uid").select("uid", "component", "packed").mapInArrow(_grams, "uid long, component long, size long, gram long")
    grams = settle(texts_, "grams")
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("gram", "n")
    common = settle(grams.join(shared, "gram"), "shared-grams")
    sizes = common.groupBy("uid").agg((F.first("size") - F.count("*")).alias("private"))
    nth = F.row_number().over(Window.partitionBy("uid").orderBy("n", "gram"))
    ranked = common.withColumn("nth", nth).join(sizes, "uid").withColumn("depth", F.col("nth") + F.col("private"))
    within = lambda own, other: own["depth"] <= own["size"] - F.ceil(least / (1 + least) * (own["size"] + other) - NEAR_NOTHING) + 1
    prefix = ranked.filter(F.col("depth") <= F.col("size") - F.ceil(least * F.col("size") - NEAR_NOTHING) + 1)
    # The smallest text at a hash bounds what the others must share there, and with it how deep they may lie.
    smallest = prefix.groupBy("gram").agg(F.min("size").alias("smallest"))
    own = F.struct("depth", "size")
    prefix = prefix.join(smallest, "gram").filter(within(own, F.greatest(F.col("smallest"), F.ceil(least * F.col("size") - NEAR_NOTHING))))
    met = cells(prefix.select("gram", "uid", "component", "size", "depth"), "gram", ["uid", "component", "size", "depth"], CELL)
    met = settle(met.filter(F.exists("members", lambda m: m["component"] != F.col("members")[0]["component"])).select("lo", "hi", "members"), "cells")
    # Rare hashes bring few texts together, but the same ones again and again: those meet once, as pairs.
    one = met.filter(F.size("members") <= FEW).select("lo", "hi", F.explode("members").alias("m"), "members")
    possible = lambda o: (
        (o["uid"] < F.col("m.uid")) & (o["component"] != F.col("m.component")) & ((F.col("lo") == F.col("hi")) | (o["part"] != F.col("m.part"))) & within(o, F.col("m.size")) & within(F.col("m"), o["size"])
    )
    pairs = one.select(F.col("m.uid").alias("b"), F.explode(F.transform(F.filter("members", possible), lambda o: o["uid"])).alias("a")).distinct()
    few = _checked(pairs, held, least)
    # Others meet in cells, one for all hashes that bring the same texts together.
    many = met.filter(F.size("members") > FEW).select("lo", "hi", F.transform(F.array_sort("members"), lambda m: F.struct(*[m[c].alias(c) for c in ("uid", "component", "part")])).alias("members")).distinct()
    many = settle(many.withColumn("cell", F.monotonically_increasing_id()), "large-cells")
    dealt = many.select("cell", "lo", "hi", F.explode("members").alias("m")).select("cell", "lo", "hi", "m.*").join(held, "uid")
    full = dealt.groupBy("cell", "lo", "hi").agg(F.collect_list(F.struct("component", "part", "packed")).alias("members")).select("lo", "hi", "members")
    with batch_rows(held.sparkSession, CELL_ROWS):
        return few.unionByName(settle(full.mapInArrow(_cells(least), "a long, b long"), "more-links"))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """``id``, ``own`` (a hash of the text as it is), ``component`` and ``least``: the smallest (no id, id, own) of the component, a row for each row of ``docs``."""
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("own"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("own", "uid", "fp")), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])
    each = settle(plain.mapInArrow(_signatures(shingle), schema), "signatures")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "own")
    unique = settle(each.groupBy("uid").agg(F.min(place).alias("least"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "unique")
    joined = connected(_links(each, unique.select("uid", F.explode("keys").alias("key")), _close(unique.select("uid", "fp")), least))
    labelled = unique.join(joined, F.col("node") == F.col("uid"), "left").select("uid", "least", F.coalesce("component", "uid").alias("component"))
    named = labelled.join(labelled.groupBy("component").agg(F.min("least").alias("first")), "component").select("uid", "first")
    return each.select("id", "own", "uid").join(named, "uid").select("id", "own", F.col("first").alias("least"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: the id and ``component_id`` (smallest id reachable over pairs of similarity ``least`` or more).

    Similarity is that of the sets of lower-case runs of ``shingle`` words, compared
    as hashes of 48 bits; texts of equal sets are one.  Texts without words are a group.
    Null ids are never a component's id unless it has no other.  An empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    classes = _classes(docs, id_col, text_col, shingle, least)
    return classes.select(F.col("id").alias(id_col), F.col("least.id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, null ids last, then of the least hash of the text.

    Rows go by id and text, so another text of a repeated id is judged on its own.
    Of rows that repeat id and text the one with the least hash of all its columns stays; a rerun keeps the same.
    """
    found = settle(_classes(docs, id_col, text_col, shingle, least).groupBy("id", "own", "least").agg(F.count("*").alias("copies")), "classes")
    chosen = F.col("least.id").eqNullSafe(F.col("id")) & (F.col("least.own") == F.col("own"))
    # Few rows need a word: those that go, and those that repeat.
    marks = found.withColumn("_stays", chosen).filter("not _stays or copies > 1").select(F.col("id").alias("_mark_id"), F.col("own").alias("_mark_own"), "_stays")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    marked = rows.join(marks, F.col("_id").eqNullSafe(F.col("_mark_id")) & (F.col("_own") == F.col("_mark_own")), "left")
    nth = F.row_number().over(Window.partitionBy("_id", "_own").orderBy(F.xxhash64("_row")))
    again = marked.filter("_stays").withColumn("_nth", nth).filter("_nth = 1")
    return marked.filter("_stays is null").select("_row.*").unionByName(again.select("_row.*"))
