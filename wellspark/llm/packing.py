"""Packing token pieces into sequences by bounded-space online best fit."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from wellspark.llm.batches import slices, texts
from wellspark.session import settle

LENGTH = 2048
#: Open bins per task, and pieces per packing task.
OPEN, PIECES = 2048, 60_000
#: Words a task keeps the ids of; a full table starts anew.
KEPT_WORDS = 1 << 19


#: Lower-case letters that no normal form changes; the words made of them alone go straight to the tokenizer's model.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Letters that stand for the bytes without one of their own in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class WordIds:
    """Token ids of words as little-endian bytes.

    The tokenizer's own splitting separates at white space and drops it, so a
    text's ids are the ids of its words one after the other.  It lowers all
    letters, so words are kept in lower case (not in texts that may hold a
    special token's string), and it separates signs from letters and digits, so
    the signs that end a word are encoded apart from it.  A tokenizer that
    answers a probe otherwise gets whole texts.
    """

    SIGNS = b'.,;:!?#$%&*|"'
    PROBE = "Ab cd, Éa\tx1. naïve-ß 'tis don't!"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.letters = Tokenizer.from_file(path), {}, _byte_letters()
        self.model, self.by_word = self.tokenizer.model, True
        try:
            parts = self.encode([self.PROBE.encode()])[0]
        except Exception:  # a model without the letters of bytes
            parts = b""
        self.by_word = parts == np.array(self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids, "<u4").tobytes()
        self.known.clear()

    def _learn(self, words: set[bytes]) -> None:
        known, rest = self.known, []
        for w in words:
            text = w.decode("utf-8", "replace").lower()
            if _PLAIN.fullmatch(text):
                letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
                known[w] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            else:
                rest.append(w)
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                known[word] = np.array(e.ids, "<u4").tobytes()

    def encode(self, documents: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for t in documents]
        lists = [t.split() if b"<|" in t else t.lower().split() for t in documents]
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        missing = {w for words in lists for w in words if w not in known}
        parted: dict[bytes, tuple[bytes, bytes]] = {}
        single: set[bytes] = set()
        for w in missing:
            core = w.rstrip(self.SIGNS)
            if len(core) < len(w) and core[-1:].isalnum():
                parted[w] = core, w[len(core) :]
                single.update(parted[w])
            else:
                single.add(w)
        self._learn(single.difference(known))
        for w, (core, signs) in parted.items():
            known[w] = known[core] + known[signs]
        return [b"".join([known[w] for w in words]) for words in lists]


_LOADED: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every document: its ids and a closing 0."""
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = WordIds(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                at, piece, start, size, crc = [], [], [], [], []
                for i, ids in enumerate(_LOADED[tokenizer].encode(texts(part.column("text")))):
                    ids += bytes(4)
                    for p, lo in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[lo : lo + 4 * length]
                        at.append(i), piece.append(p), start.append(lo // 4), size.append(len(own) // 4), crc.append(zlib.crc32(own))
                rest = [pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, size, crc))]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), *rest], ["id", "piece", "start", "length", "ids_crc32"])

    fields = [("id", kind), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, T.StructType([T.StructField(*f) for f in fields]))


class BestFit:
    """Bins of ``length``; open ones stand in stacks by free space, with a bit for each stack in use.

    A piece goes to the open bin with the least free space that holds it.  If
    none does, a new bin opens; beyond ``most`` open bins the fullest closes.
    """

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.stacks: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits, self.open, self.bins = 0, 0, 0

    def _pop(self, free: int) -> int:
        bin_ = self.stacks[free].pop()
        if not self.stacks[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._pop(free)
        else:
            free, bin_ = self.length, self.bins
            self.bins += 1
        left = free - size
        if left:
            self.stacks[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.length - free


def pack(cut: DataFrame, length: int = LENGTH, open_bins: int = OPEN, per_task: int = PIECES) -> DataFrame:
    """``cut`` (from ``pieces``) with ``sequence_id`` and ``offset``.

    Pieces are dealt by hash to tasks of about ``per_task`` and packed in hash
    order.  Numbers are unique over tasks; a rerun gives the same sequences.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = BestFit(length, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            sequence, offset = zip(*placed) if placed else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + s for s in sequence], pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    tasks = -(-max(1, cut.count()) // per_task)
    order = F.xxhash64("id", "piece", "ids_crc32")
    dealt = cut.repartition(tasks, order).sortWithinPartitions(order, "id", "piece", "length", "ids_crc32")
    return dealt.mapInArrow(work, T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null, empty or white text is its closing 0 alone.  Texts of any length are
    tokenized whole; only documents over 2,048 ids are cut.  Repeated rows and
    null ids are packed like others.  An empty table gives no rows; other columns
    are not read.
    """
    cut = settle(pieces(docs, tokenizer, id_col, text_col), "pieces")
    return pack(cut, **options).withColumnRenamed("id", id_col)
