"""Near-duplicate vectors: iterative quantisation codes, multi-index Hamming tables, exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wellspark.llm.buckets import cells
from wellspark.llm.components import connected
from wellspark.llm.simhash import stars
from wellspark.session import settle

BITS = 64
#: Vectors the rotation is learned from, those with the smallest hashes of their ids; all vectors are indexed.
FIT_ROWS = 8192
#: Share of planted pairs at the least cosine that the tables may miss, and pairs planted of either kind.
MISS, PLANTED = 0.01, 2000
#: Substring lengths that are weighed, and what comparing a pair costs against sending a key.
LENGTHS, COMPARE = range(6, 33), 0.05


def learn_rotation(sample: np.ndarray, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and d x 64 projection: principal axes turned so that the signs balance (ITQ)."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(d, BITS)]
    parts, width = [], 0
    while width < BITS:  # fewer dimensions than bits: several rotations
        turn = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
        flat = centred @ axes
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ vt).T
        parts.append(axes @ turn)
        width += turn.shape[1]
    return mean, np.hstack(parts)[:, :BITS]


def _usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def planted_pairs(sample: np.ndarray, least: float, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors and partners at cosine ``least``: off in any direction, and off as sample vectors differ from each other."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(len(sample), size=PLANTED)]
    out = []
    for off in (rng.standard_normal(x.shape), sample[rng.integers(len(sample), size=PLANTED)] - sample[rng.integers(len(sample), size=PLANTED)] + 1e-9 * rng.standard_normal(x.shape)):
        off = off - (off * x).sum(axis=1, keepdims=True) * x
        off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
        out.append((x, least * x + math.sqrt(1 - least * least) * off))
    return out


class Tables:
    """How many substrings of which length, taken from as many learned codes of 64 bits as that needs.

    The bits in which planted pairs differ decide: for each length, the tables that
    miss at most ``MISS`` of them; of the lengths the one whose keys and expected
    comparisons among ``n`` vectors cost least, so that it follows log2 n.  Tables
    are added until the planted pairs really are found.
    """

    def __init__(self, sample: np.ndarray, n: int, least: float):
        self.sample, self.words = sample, [learn_rotation(sample)]
        pairs = planted_pairs(sample, least) if len(sample) else []
        flips = [self._flips(x, y, 0) for x, y in pairs]

        def needed(length: int) -> int:
            shares = [np.mean([(f[:, i : i + length].sum(axis=1) <= 1).mean() for i in range(0, BITS - length + 1, length)]) for f in flips]
            return math.ceil(math.log(MISS) / math.log(1 - min(0.999, max(1e-3, min(shares))))) if shares else 1

        self.length = min(LENGTHS, key=lambda s: needed(s) * s * (1 + COMPARE * n / 2 ** (s - 1)))
        self.count = needed(self.length)
        while True:
            self._learn()
            differ = [np.hstack([self._flips(x, y, w) for w in range(len(self.words))]) for x, y in pairs]
            found = [np.logical_or.reduce([d[:, self.start(t) : self.start(t) + self.length].sum(axis=1) <= 1 for t in range(self.count)]).mean() for d in differ]
            if min(found, default=1.0) >= 1 - MISS:
                break
            self.count += 1
        self.radius = max((int(d.sum(axis=1).max()) for d in differ), default=BITS * len(self.words))

    def _learn(self) -> None:
        while len(self.words) * (BITS // self.length) < self.count:
            w = len(self.words)
            self.words.append(learn_rotation(self.sample[w % 4 :: 4] if len(self.sample) > 1024 else self.sample, seed=7 + w))

    def _flips(self, x: np.ndarray, y: np.ndarray, word: int) -> np.ndarray:
        mean, axes = self.words[word]
        return ((x - mean) @ axes >= 0) != ((y - mean) @ axes >= 0)

    def start(self, table: int) -> int:
        """First bit of a table's substring, counted over all words; no substring crosses a word."""
        word, place = divmod(table, BITS // self.length)
        return BITS * word + self.length * place

    def masks(self) -> list[tuple[int, int]]:
        """(word, mask) of each table."""
        return [(self.start(t) // BITS, ((1 << self.length) - 1) << self.start(t) % BITS) for t in range(self.count)]


def _codes(words: list[tuple[np.ndarray, np.ndarray]]):
    """Codes of 64 bits a word; vectors of another dimension than the learned one get random hyperplanes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(v, np.float64) for v in batch.column("vector").to_pylist()]
            code = np.zeros((len(rows), len(words)), np.uint64)
            for d in {len(v) for v in rows}:
                at = [i for i, v in enumerate(rows) if len(v) == d]
                x = np.vstack([rows[i] for i in at])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for w, (mean, axes) in enumerate(words):
                    centre, turn = (mean, axes) if d == len(mean) else (np.zeros(d), np.random.default_rng([d, w]).standard_normal((d, BITS)))
                    code[at, w] = np.packbits((x - centre) @ turn >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(words), pa.int32()), pa.array(code.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("label"), codes, pa.array([len(v) for v in rows], pa.int32())], ["uid", "label", "code", "dim"])

    return work


def _near(code: np.ndarray, t: int, j: int, masks: list[tuple[int, int]], radius: int) -> np.ndarray:
    """Pairs of a cell within ``radius`` that no earlier table or key shows."""
    differ = [code[:, w][:, None] ^ code[:, w][None, :] for w in range(code.shape[1])]
    near = sum(np.bitwise_count(d).astype(np.int32) for d in differ) <= radius
    for word, mask in masks[:t]:
        near &= np.bitwise_count(differ[word] & np.uint64(mask)) > 1
    if j:  # equal substrings meet under every wildcard; the first one counts
        near &= (differ[masks[t][0]] & np.uint64(masks[t][1])) != 0
    np.fill_diagonal(near, False)
    return near


def _candidates(masks: list[tuple[int, int]], words: int, radius: int):
    """Members of a cell that have a partner within ``radius`` which no earlier table or key shows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            flat = column.flatten()
            uid, part = flat.field("uid").to_numpy(zero_copy_only=False), flat.field("part").to_numpy(zero_copy_only=False)
            code = flat.field("code").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            t, j, lo_part, hi_part = (batch.column(c).to_numpy() for c in ("t", "j", "lo", "hi"))
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for k, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                near = _near(code[lo:hi], t[k], j[k], masks, radius)
                if lo_part[k] != hi_part[k]:
                    near &= part[lo:hi, None] != part[None, lo:hi]
                has = near.any(axis=1)
                out.append((k, uid[lo:hi][has], part[lo:hi][has]))
            at = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)
            names = ["cell", "t", "j", "lo", "hi", "uid", "part"]
            cell = batch.column("cell").take(pa.array(at))
            rest = [pa.array(v[at], pa.int32()) for v in (t, j, lo_part, hi_part)]
            yield pa.RecordBatch.from_arrays([cell, *rest, pa.array(np.concatenate([np.zeros(0, np.int64), *(o[1] for o in out)]).astype(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int32), *(o[2] for o in out)]).astype(np.int32))], names)

    return work


def _verified(masks: list[tuple[int, int]], radius: int, least: float):
    """Per member of a cell: linked rows it gains there and its root in the cell's spanning forest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, gains, roots = [], [], []
            for t, j, lo, hi, members in zip(*(batch.column(c).to_pylist() for c in ("t", "j", "lo", "hi", "members"))):
                x = np.array([m["vector"] for m in members], np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                norm = np.linalg.norm(x, axis=1)
                part, n, uid = (np.array([m[c] for m in members], np.int64) for c in ("part", "n", "uid"))
                code = np.array([m["code"] for m in members], np.int64).view(np.uint64)
                links = (x @ x.T / np.outer(norm, norm) >= least) & _near(code, t, j, masks, radius)
                if lo != hi:
                    links &= part[:, None] != part[None, :]
                links = links | links.T
                has = links.any(axis=1)
                uids.append(uid[has])
                gains.append((links @ n)[has])
                roots.append(uid[stars(links)][has])
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64)) for v in (uids, gains, roots)]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "gain", "root"])

    return work


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per row of ``rows``: the id, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label and length link at cosine ``least`` or more, in double
    precision.  Candidates are pairs whose codes differ in at most one bit of some
    table's substring (a key for each bit left out) and in no more bits than
    planted pairs do; ``Tables`` says how many tables of what length that takes.
    A pair counts in its first table and key only, so counts need no list of
    pairs.  Equal vectors are one node with a count.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without label, link with nothing: n_links 0, component_id their own id.
    Rows that repeat an id count once, with the smallest label and vector.  A row
    without id links with nothing and has no component; ``kept`` is then null.
    An empty table gives no rows; other columns are not read.
    """
    source = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = source.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    single = usable.groupBy("id").agg(F.min(F.struct("label", F.col("vector").cast("array<double>").alias("vector"))).alias("v")).select("id", "v.*")
    nodes = settle(single.groupBy("label", "vector").agg(F.min("id").cast("long").alias("uid"), F.count("*").alias("n")), "nodes")
    members = single.join(nodes.select("label", "vector", "uid", F.col("n").alias("copies")), ["label", "vector"]).select("id", "uid", "copies")

    first = nodes.select("vector").orderBy(F.xxhash64("uid"), "uid").limit(fit_rows).collect()
    sizes = [len(r[0]) for r in first]
    common = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 1
    sample = np.array([r[0] for r in first if len(r[0]) == common], np.float64).reshape(-1, common)
    sample = sample / np.abs(sample).max(axis=1, keepdims=True) if len(sample) else sample
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    tables = Tables(sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample, largest, least)
    masks, words, radius = tables.masks(), len(tables.words), tables.radius
    coded = settle(nodes.select("uid", "label", "vector").mapInArrow(_codes(tables.words), f"uid long, label {nodes.schema['label'].dataType.simpleString()}, code array<long>, dim int"), "codes")

    keys = [(t, j, w, mask & ~(1 << bit)) for t, (w, mask) in enumerate(masks) for j, bit in enumerate(b for b in range(BITS) if mask >> b & 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    probes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(j).alias("j"), F.lit(w).alias("w"), F.lit(signed(m)).cast("long").alias("mask")) for t, j, w, m in keys])
    keyed = coded.select("uid", "code", "label", "dim", F.explode(probes).alias("p")).select(
        F.struct(F.col("p.t").alias("t"), F.col("p.j").alias("j"), "label", "dim", F.get("code", F.col("p.w")).bitwiseAND(F.col("p.mask")).alias("sub")).alias("key"), "uid", "code"
    )
    found = cells(keyed, "key", ["uid", "code"]).select(F.xxhash64("key").alias("cell"), "key.t", "key.j", "lo", "hi", "members")
    pairs = found.mapInArrow(_candidates(masks, words, radius), "cell long, t int, j int, lo int, hi int, uid long, part int")
    full = pairs.join(coded.select("uid", "code"), "uid").join(nodes.select("uid", "vector", "n"), "uid")
    grouped = full.groupBy("cell", "t", "j", "lo", "hi").agg(F.collect_list(F.struct("uid", "code", "part", "n", "vector")).alias("members"))
    gained = settle(grouped.mapInArrow(_verified(masks, radius, least), "uid long, gain long, root long"), "gained")

    joined = connected(gained.select("uid", "root"))
    totals = gained.groupBy("uid").agg(F.sum("gain").alias("gain"))
    result = members.join(totals, "uid", "left").join(joined, F.col("uid") == F.col("node"), "left").select(
        F.col("id").alias("_id"), (F.col("copies") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), F.coalesce("component", "uid").alias("component_id")
    )
    out = source.select("id").join(result, F.col("id") == F.col("_id"), "left")
    component = F.coalesce("component_id", F.col("id").cast("long"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
