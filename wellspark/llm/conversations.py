"""Conversation structure repair: cheapest edits by a stream of turns in order, one conversation after the other.

Turns are dealt by conversation and sorted by turn; ``mapInPandas`` carries the
state of a shortest-path search over Arrow batches.  The stream runs from the
last turn to the first, so that a two-byte backpointer a row (the least edit for
each of the four states, and whether the row opens as system) is all that is
kept; beyond a megabyte the pointers go to the task's own unlinked scratch file.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import repeat
from tempfile import SpooledTemporaryFile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wellspark.session import settle

#: Bytes of a conversation's pointers or edits that stay in memory; edits in a row of the result.
SPILL, PAGE = 1 << 20, 1 << 16
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
#: Costs, and what a truncated row that stays adds (fixed values).
COSTS, TRUNCATED = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}, 5
#: States: nothing yet, after system, after user, after assistant; where an inserted or renamed turn leads, and as what.
ADDED = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
END = (0, 10, 5, 0)
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)


def step(after: tuple[int, ...], initial: str, cut: bool) -> tuple[tuple[int, ...], int]:
    """Costs from each state before a row that may stay, given those after it; and the backpointer."""
    stays = TRUNCATED if cut else 0
    options = []
    for s in range(4):
        own = {DELETE: COSTS[DELETE] + after[s], REROLE: COSTS[REROLE] + stays + after[ADDED[s]]}
        if initial in KEPT[s]:
            own[KEEP] = COSTS[KEEP] + stays + after[KEPT[s][initial]]
        options.append(own)
    cost = direct = [min(o.values()) for o in options]
    for _ in range(2):
        cost = [min(direct[s], COSTS[INSERT] + cost[ADDED[s]]) for s in range(4)]
    pointer = (initial == "s") << 8
    for s, own in enumerate(options):
        own[INSERT] = COSTS[INSERT] + cost[ADDED[s]]
        pointer |= min(code for code, c in own.items() if c == cost[s]) << 2 * s
    return tuple(cost), pointer


class Search:
    """The state of one conversation's search, fed from its last turn to its first."""

    def __init__(self, known: dict):
        self.known, self.after, self.base, self.illegal, self.later, self.n = known, END, 0, 0, "", 0
        self.spool, self.pointers = SpooledTemporaryFile(max_size=SPILL), array("H")

    def _put(self, pointer: int, times: int = 1) -> None:
        self.n += times
        while times:
            now = min(times, PAGE)
            self.pointers.extend(repeat(pointer, now))
            times -= now
            if len(self.pointers) >= PAGE:
                self.spool.write(self.pointers.tobytes())
                self.pointers = array("H")

    def row(self, initial: str, fault: int, copies: int) -> None:
        if self.later:
            self.illegal += initial + self.later not in ("su", "ua", "au")
        self.illegal, self.later = self.illegal + copies - 1, initial or " "
        gone = copies if fault in (BLANK, DUPLICATE) else copies - 1
        if gone:  # whatever the state, the least edit is to delete
            self.base += COSTS[DELETE] * gone
            self._put(0, gone)
        if gone < copies:
            at = self.after, initial, fault == CUT
            if at not in self.known:
                cost, pointer = step(*at)
                least = min(cost)
                self.known[at] = tuple(c - least for c in cost), least, pointer
            self.after, more, pointer = self.known[at]
            self.base += more
            self._put(pointer)

    def pages(self) -> Iterator[str]:
        """The edits from the first turn on, in pieces."""
        self.spool.write(self.pointers.tobytes())
        state, out = 0, []
        for stop in range(self.n, 0, -PAGE):
            start = max(0, stop - PAGE)
            self.spool.seek(2 * start)
            pointers = array("H")
            pointers.frombytes(self.spool.read(2 * (stop - start)))
            for pointer in reversed(pointers):
                while (code := pointer >> 2 * state & 3) == INSERT:
                    out.append("I")
                    state = ADDED[state]
                out.append(LETTERS[code])
                if code == KEEP:
                    state = 1 if state == 0 and pointer >> 8 else ADDED[state]
                elif code == REROLE:
                    state = ADDED[state]
            if start:
                yield "".join(out)
                out = []
        yield "".join(out) + "I" * (END[state] // COSTS[INSERT])
        self.spool.close()

    def cost(self) -> int:
        return self.base + self.after[0]


def _plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict = {}
    key, search, rows = None, None, []

    def flush(least: int) -> Iterator[pd.DataFrame]:
        if len(rows) >= least:
            yield pd.DataFrame(rows, columns=["key", "page", "edits", "cost", "illegal"])
            rows.clear()

    def end() -> Iterator[pd.DataFrame]:
        if search is not None:
            for page, edits in enumerate(search.pages()):
                rows.append((key, page, edits, 0 if page else search.cost(), 0 if page else search.illegal))
                yield from flush(1 if page else 1000)

    for frame in frames:
        for now, initial, fault, copies in zip(frame["key"].tolist(), frame["initial"].tolist(), frame["fault"].tolist(), frame["copies"].tolist()):
            if now != key:
                yield from end()
                key, search = now, Search(known)
            search.row(initial, fault, copies)
    yield from end()
    yield from flush(1)


class Edits:
    """A conversation's edits, written page by page and read once in order."""

    def __init__(self):
        self.spool, self.read, self.written, self.buffer, self.at = SpooledTemporaryFile(max_size=SPILL), 0, 0, b"", 0

    def write(self, edits: str) -> None:
        self.spool.seek(self.written)
        self.written += self.spool.write(edits.encode())

    def next(self) -> str:
        """The next edit, empty at the end."""
        if self.at == len(self.buffer):
            self.spool.seek(self.read)
            self.buffer, self.at = self.spool.read(PAGE), 0
            self.read += len(self.buffer)
            if not self.buffer:
                return ""
        self.at += 1
        return chr(self.buffer[self.at - 1])

    def skip(self, n: int) -> None:
        held = min(n, len(self.buffer) - self.at)
        self.at += held
        self.read += n - held


def _apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits, then turns, of one conversation after the other to the repaired turns."""
    key, edits, state, position, rows, held = None, None, 0, 0, [], 0

    def add(role: str, text: str) -> None:
        nonlocal position, held
        rows.append((key, position, role, text))
        position, held = position + 1, held + len(text)

    def insert() -> None:
        nonlocal state
        state = ADDED[state]
        add(ROLES[state], "")

    def tail() -> None:
        if edits is not None:
            while edits.next() == "I":
                insert()
            edits.spool.close()

    for frame in frames:
        for now, tag, page, role, text, copies in zip(*(frame[c].tolist() for c in ("key", "tag", "edits", "role", "text", "copies"))):
            if now != key:
                tail()
                key, edits, state, position = now, Edits(), 0, 0
            if not tag:
                edits.write(page)
                continue
            while (edit := edits.next()) == "I":
                insert()
            edits.skip(copies - 1)
            if edit == "K":
                state = KEPT[state][role[:1]]
                add(role, text)
            elif edit == "R":
                state = ADDED[state]
                add(ROLES[state], text)
            if len(rows) >= 2000 or held > 2_000_000:
                yield pd.DataFrame(rows, columns=["key", "position", "role", "text"])
                rows, held = [], 0
    tail()
    yield pd.DataFrame(rows, columns=["key", "position", "role", "text"])


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, digest, out = None, None, []
    for frame in frames:
        for now, role, text in zip(frame["key"].tolist(), frame["role"].tolist(), frame["text"].tolist()):
            if now != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(f"{role}:{text}".encode())
            else:
                digest.update(f"\n{role}:{text}".encode())
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
            out = []
    if digest is not None:
        out.append((key, digest.hexdigest()))
    yield pd.DataFrame(out, columns=["key", "repaired_sha256"])


def _key(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with ``copies``: rows damaged by the crc32 of conversation and turn; nulls but of the turn are one space."""
    blank = F.lit(" ")
    what = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    damaged = rows.withColumn("_what", what).filter("_what <> 0").select(
        "conv_id", "turn", F.when(F.col("_what") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("_what") == 1, "").when(F.col("_what") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("_what") == 3, 2).otherwise(1).alias("copies"),
    )
    return damaged


class Repairs:
    """The repairs of all conversations in ``rows``: ``turns`` (with faults and copies), ``plan`` (edits by page), ``repaired`` and ``summary``.

    Turns are taken by turn number, nulls first, then role, then text by code
    point; equal rows are one with its number of copies from the first shuffle
    on.  ``rows`` may bring ``copies``.  Null roles and texts are one space, which
    is a blank text and no legal role; so is an empty role.  A null conversation
    id is one conversation.  Empty tables give empty results; other columns are not read.
    """

    def __init__(self, rows: DataFrame):
        self.id_type = rows.schema["conv_id"].dataType
        copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
        blank = F.lit(" ")
        each = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), copies.alias("copies"))
        grouped = each.groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        held = settle(grouped.withColumn("said", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)), "turns")
        first = held.groupBy("key", "said").agg(F.max(F.col("turn").isNull()).alias("before_all"), F.min("turn").alias("first"))
        late = F.when(F.col("before_all"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
        last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
        fault = F.when(last == "", BLANK).when(late, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(NO_FAULT)
        self.turns = settle(held.join(first, ["key", "said"]).select("key", "turn", "role", "text", "copies", fault.alias("fault")), "faults")
        backward = self.turns.repartition("key").sortWithinPartitions("key", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"))
        slim = backward.select("key", F.substring("role", 1, 1).alias("initial"), "fault", "copies")
        self.plan = settle(slim.mapInPandas(_plan, "key string, page long, edits string, cost long, illegal long"), "repairs")
        pages = self.plan.select("key", F.lit(0).alias("tag"), "page", "edits", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
        turns = self.turns.select("key", F.lit(1).alias("tag"), F.lit(0).cast("long").alias("page"), F.lit("").alias("edits"), "turn", "role", "text", "copies")
        both = pages.unionByName(turns).repartition("key").sortWithinPartitions("key", "tag", "page", F.asc_nulls_first("turn"), "role", "text")
        self._repaired = both.select("key", "tag", "edits", "role", "text", "copies").mapInPandas(_apply, "key string, position long, role string, text string")

    def _conv(self) -> Column:
        return F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(self.id_type).alias("conv_id")

    @property
    def repaired(self) -> DataFrame:
        """``conv_id``, ``position``, ``role``, ``text`` of all turns after the repair."""
        return self._repaired.select(self._conv(), "position", "role", "text")

    @property
    def summary(self) -> DataFrame:
        """``key``, ``conv_id``, counts of faults, ``gaps``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` per conversation that has rows."""
        own = F.col("fault") == DUPLICATE
        free = F.col("fault").isin(NO_FAULT, CUT)
        facts = self.turns.groupBy("key").agg(
            F.sum(F.when(F.col("fault") == BLANK, F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(own, F.col("copies")).when(free, F.col("copies") - 1).otherwise(0)).alias("duplicate"),
            F.sum((F.col("fault") == CUT).cast("long")).alias("truncated"),
        )
        spans = self.turns.select("key", "turn").distinct().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "edits"))), lambda x: x["edits"]), "")
        plans = self.plan.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), audit.alias("audit"))
        digests = self._repaired.mapInPandas(_digest, "key string, repaired_sha256 string")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        joined = facts.join(spans, "key").join(plans, "key").join(digests, "key", "left")
        return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)).select("key", self._conv(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def audit(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``rows``: what the damaged conversation lacks, the cheapest edits and the digest of the repaired turns.

    Conversations of which no row is left have zeros, an empty ``audit`` and the
    digest of the empty text.  See ``Repairs`` for nulls, ties and repeated rows.
    """
    found = Repairs(damage(rows)).summary
    every = rows.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    texts = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    return every.join(found.drop("conv_id"), "key", "left").withColumns(zeros | texts).drop("key")
