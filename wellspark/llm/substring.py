"""Repeated passages: a compressed FM-index per shard, asked by backward search over its wavelet matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from wellspark.llm.batches import slices, texts

#: Words of a window; the index reads them as symbols of STEP words, so a window is DEPTH backward steps.
WINDOW, STEP = 20, 5
DEPTH = WINDOW // STEP
#: Words of the anchor that brings equal windows into one shard, and windows of a segment at most.
ANCHOR, RUN = 5, 63
#: Words of one index; a larger shard is cut between anchors.
SHARD_WORDS = 300_000
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


# --- segments -------------------------------------------------------------------------------------------------


def segments(words: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their anchor: document, start, windows, anchor, content hash, whether the anchor occurs in it twice.

    The anchor of a window is the least hash among its runs of ANCHOR words, so
    equal windows have equal anchors wherever they stand.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    usable = np.maximum(sizes - WINDOW + 1, 0)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if not usable.sum():
        return empty
    h = _mixed(np.fromiter((xxhash.xxh64_intdigest(w) for ws in words for w in ws), np.uint64, total))
    gram = h.copy()
    for k in range(1, ANCHOR):
        gram = gram * ODD
        gram[: total - k] += h[k:]
    gram = _mixed(gram)
    least, width, span = gram, 1, WINDOW - ANCHOR + 1
    while width < span:  # sliding minimum by doubling
        shift = min(width, span - width)
        new = least.copy()
        new[: total - shift] = np.minimum(least[: total - shift], least[shift:])
        least, width = new, width + shift
    doc = np.repeat(np.arange(len(words)), usable)
    at = np.repeat(first, usable) + np.arange(len(doc)) - np.repeat(np.cumsum(usable) - usable, usable)
    value = least[at]
    starts = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
    begin = np.flatnonzero(starts)
    inside = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    begin = np.flatnonzero(inside % RUN == 0)
    n = np.diff(np.r_[begin, len(at)])
    pos, anchor = at[begin], value[begin]
    seen = np.zeros(len(begin), np.int64)
    for k in range(int(n.max()) + span - 1):
        inner = k < n + span - 1
        seen[inner] += gram[pos[inner] + k] == anchor[inner]
    power = np.cumprod(np.r_[np.uint64(1), np.full(total, ODD)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(total, np.uint64(pow(int(ODD), -1, 1 << 64)))])
    prefix = np.r_[np.uint64(0), np.cumsum(h * power[:-1])]
    content = _mixed((prefix[pos + n + WINDOW - 1] - prefix[pos]) * inverse[pos] + n.astype(np.uint64))
    return doc[begin], pos - first[doc[begin]], n, anchor, content, seen > 1


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a slice of documents; of equal ones only the earliest keeps its anchor, the others are known repeats."""
    for batch in batches:
        for part in slices(batch, "text"):
            doc, start, n, anchor, content, inner = segments([t.split() for t in texts(part.column("text"))])
            own, th = part.column("own").to_numpy()[doc], part.column("th").to_numpy()[doc]
            order = np.lexsort((start, own, content))
            c = content[order]
            lead = np.maximum.accumulate(np.where(np.r_[True, c[1:] != c[:-1]], np.arange(len(c)), 0)) if len(c) else order
            same = order[lead] if len(c) else order
            known = np.zeros(len(c), bool)
            known[order] = (own[order] != own[same]) | (start[order] != start[same])
            spread = _mixed(own.astype(np.uint64) * ODD + start.astype(np.uint64))
            key = np.where(known, spread, anchor).view(np.int64)
            value = start << 8 | n << 2 | known * 2 | inner
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, own, th, value)], ["key", "own", "th", "value"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = (batch.column("text")[i].as_py() or "").encode().split()
            rows = batch.column("segments")[i].as_py()
            content = [None if r["value"] & 2 else b" ".join(words[r["value"] >> 8 : (r["value"] >> 8) + (r["value"] >> 2 & 63) + WINDOW - 1]) for r in rows]
            own, th = batch.column("own")[i].as_py(), batch.column("th")[i].as_py()
            columns = [[r["key"] for r in rows], [own] * len(rows), [th] * len(rows), [r["value"] for r in rows]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(content, pa.binary())], ["key", "own", "th", "value", "content"])


# --- index ----------------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Bit planes of a symbol sequence with rank directories; ``rank`` counts a symbol before a position."""

    def __init__(self, symbols: np.ndarray, count: int) -> None:
        self.levels = max(1, int(count - 1).bit_length())
        self.planes, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            plane = np.zeros(len(bits) // 64 + 1, np.uint64)
            plane.view(np.uint8)[: len(packed)] = packed
            self.planes.append(plane)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(plane), dtype=np.int64)[:-1]])
            self.zeros.append(len(bits) - int(bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.starts = self._walk(np.arange(count), np.zeros(count, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[i][word] + np.bitwise_count(self.planes[i][word] & below)
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbol, at) - self.starts[symbol]


class FMIndex:
    """Index over word sequences, read as overlapping symbols of STEP words, STEP apart; suffixes sorted to DEPTH symbols.

    Sorting to that depth is enough for backward searches of up to DEPTH symbols.
    """

    def __init__(self, sequences: list[bytes]) -> None:
        numbers: dict[bytes, int] = {}
        lists = [s.split() for s in sequences]
        lengths = np.array([len(x) for x in lists], np.int64)
        self.lengths, self.first = lengths, np.cumsum(lengths + 1) - lengths - 1
        size = int((lengths + 1).sum()) + 2 * STEP
        size += -size % STEP
        word = np.zeros(size, np.int64)  # 0 stands between sequences
        inside = np.ones(size, bool)
        inside[self.first + lengths] = False
        inside[int((lengths + 1).sum()) :] = False
        word[inside] = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for x in lists for w in x), np.int64, int(lengths.sum()))
        two = self._paired(word, word, 1)
        symbol = self._paired(self._paired(two, two, 2), word, 4)
        whole = inside.copy()
        for k in range(1, STEP):
            whole[: size - k] &= inside[k:]
        whole[size - STEP + 1 :] = False
        kinds, dense = np.unique(symbol[whole], return_inverse=True)
        self.symbol = np.zeros(size, np.int64)
        self.symbol[whole] = dense + 1
        half = self._paired(self.symbol, self.symbol, STEP)
        full = self._paired(half, half, 2 * STEP)
        # Suffixes in order of their first DEPTH symbols; the text runs through the residues of STEP one after the other.
        order = np.argsort(full, kind="stable")
        self.group = full
        self.suffixes = order
        before = np.where(order >= STEP, self.symbol[order - STEP], 0)
        self.below = np.r_[0, np.cumsum(np.bincount(self.symbol, minlength=len(kinds) + 1))]
        self.tree = WaveletMatrix(before, len(kinds) + 1)

    @staticmethod
    def _paired(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
        """Ranks of the pairs (a[i], b[i + gap]); beyond the end stands 0."""
        right = np.r_[b[gap:], np.zeros(gap, np.int64)]
        return np.unique(a * (int(b.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)

    def intervals(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix intervals of the windows at these positions, and the words matched elsewhere too, counted from the window's end.

        A search stops as soon as only one suffix is left: the window itself.
        """
        last = self.symbol[at + WINDOW - STEP]
        lo, hi = self.below[last], self.below[last + 1]
        matched = np.where(hi - lo > 1, STEP, 0)
        live = np.flatnonzero(hi - lo > 1)
        for step in range(2, DEPTH + 1):
            c = self.symbol[at[live] + WINDOW - step * STEP]
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] - lo[live] > 1]
            matched[live] = step * STEP
        return lo, hi, matched


def repeated_windows(sequences: list[bytes], places: np.ndarray) -> list[tuple[int, int, int]]:
    """(sequence, first word, end) of the runs of words covered by windows that also start at an earlier place.

    ``places`` has for every sequence a number that grows with the place of its
    first word; word w of it stands at places + w.
    """
    index = FMIndex(sequences)
    counts = index.lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(sequences)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = index.first[owner] + offset
    lo, hi, matched = index.intervals(at)
    hit = np.flatnonzero(matched == WINDOW)
    if not len(hit):
        return []
    # The interval of a whole window is the run of suffixes of its group: its earliest place is the group's.
    place = np.full(len(index.symbol), np.iinfo(np.int64).max)
    place[at] = places[owner] + offset
    sorted_groups = index.group[index.suffixes]
    heads = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]])
    earliest = np.minimum.reduceat(place[index.suffixes], heads)
    first = earliest[np.searchsorted(heads, lo[hit], side="right") - 1]
    later = hit[first < place[at[hit]]]
    if not len(later):
        return []
    breaks = np.r_[True, (owner[later][1:] != owner[later][:-1]) | (offset[later][1:] != offset[later][:-1] + 1)]
    begin = np.flatnonzero(breaks)
    end = np.r_[begin[1:], len(later)] - 1
    return list(zip(owner[later][begin].tolist(), offset[later][begin].tolist(), (offset[later][end] + WINDOW).tolist()))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed word ranges, from the segments of a partition in order of their anchors."""
    earliest: dict[bytes, tuple[int, int, int]] = {}
    out: list[tuple[int, int, int, int]] = []
    held, key = 0, None

    def shard() -> None:
        nonlocal held
        if earliest:
            own = np.array([p[0] for p in earliest.values()], np.int64)
            start = np.array([p[1] for p in earliest.values()], np.int64)
            places = np.unique(own, return_inverse=True)[1].astype(np.int64) << 32 | start
            rows = list(earliest.values())
            for i, lo, hi in repeated_windows(list(earliest), places):
                out.append((rows[i][0], rows[i][2], rows[i][1] + lo, rows[i][1] + hi))
        earliest.clear()
        held = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["own", "th", "lo", "hi"])

    for batch in batches:
        for k, own, th, value, content in zip(*(batch.column(c).to_pylist() for c in ("key", "own", "th", "value", "content"))):
            start, size = value >> 8, (value >> 2 & 63) + WINDOW - 1
            if content is None:
                out.append((own, th, start, start + size))
                continue
            if k != key and held >= SHARD_WORDS:
                shard()
            key = k
            known = earliest.get(content)
            if known is None:
                held += size
                earliest[content] = (own, start, th)
            elif (own, start) > known[:2]:  # all its windows stand earlier too
                out.append((own, th, start, start + size))
            elif (own, start) < known[:2]:
                out.append((known[0], known[2], known[1], known[1] + size))
                earliest[content] = (own, start, th)
            elif th != known[2]:  # another text under the same id: neither is earlier; both get what the search finds
                earliest[content + b" "] = (own, start, th)
        if len(out) >= 20_000:
            yield flush()
    shard()
    yield flush()


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digest, kept = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = (text or "").encode().split()
            out, last = [], 0
            for s in sorted(spans or (), key=lambda s: s["lo"]):
                out += words[last : s["lo"]] if s["lo"] > last else []
                last = max(last, s["hi"])
            out += words[last:]
            whole = b" ".join(out)
            n_words.append(len(words)), n_removed.append(len(words) - len(out)), kept.append(whole.decode()), digest.append(hashlib.sha256(whole).hexdigest())
        columns = [batch.column("own"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["own", "n_words", "n_removed", "kept_sha256", "kept"])


def removed_ranges(keyed: DataFrame) -> DataFrame:
    """``own``, ``th``, ``lo``, ``hi``: word ranges of the texts of ``keyed`` (``own``, ``th``, ``text``) that stand earlier as well."""
    found = keyed.mapInArrow(_anchored, "key long, own long, th long, value long")
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    kept = counted.filter((F.col("n") > 1) | (F.col("value").bitwiseAND(3) > 0))
    per_text = kept.groupBy("own", "th").agg(F.collect_list(F.struct("key", "value")).alias("segments"))
    full = keyed.join(per_text, ["own", "th"]).select("own", "th", "text", "segments")
    contents = full.mapInArrow(_contents, "key long, own long, th long, value long, content binary")
    return contents.repartition("key").sortWithinPartitions("key").mapInArrow(_searched, "own long, th long, lo long, hi long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts_too``, ``kept``.

    A word goes if a window of 20 words that covers it also starts earlier, in a
    smaller id or before it in the same document.  Texts are cut into segments of
    windows that share an anchor; only anchors seen twice go on, and equal
    segments are one entry of the index with their earliest place.  Each shard's
    segments are indexed, then asked for the matching statistics of every window.

    Null, empty and short texts keep all words.  A null id comes before all
    others.  Repeated rows of an id do not come before each other.  An empty
    table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Both joins read exactly these columns by the same keys, so the texts are shuffled once and the exchange is used again.
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("own"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = removed_ranges(keyed).groupBy("own", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = keyed.join(spans, ["own", "th"], "left").select("own", "text", "spans")
    done = joined.mapInArrow(_cleaned, "own long, n_words long, n_removed long, kept_sha256 string, kept string")
    named = done.withColumn("own", F.when(F.col("own") != NO_ID, F.col("own")).cast(docs.schema[id_col].dataType)).withColumnRenamed("own", id_col)
    return named if texts_too else named.drop("kept")
