"""Personal data: patterns, and a skip-chain conditional random field over the tokens of a document."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wellspark.llm.batches import slices

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: 0 is no personal data, then KINDS.
LABELS = 1 + len(KINDS)
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NUMBER = re.compile(r"[+(]*[0-9][0-9().-]*")
_EDGES = "\"'`.,;:!?#$%&*|<>[]{}=~"
_MASKS = {k: f"[{name.upper()}]" for k, name in enumerate(KINDS)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind that pass their checks, by kind and start; linear in the text."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append((0, start, end.end()))
            last = end.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


@dataclass
class Node:
    """A token with a digit or an at sign; all others can only be without label."""

    start: int
    end: int
    shape: str
    keys: tuple[str, ...]
    follows: bool  # only white space between it and the node before
    label: int  # of the base match it overlaps, else 0


def _pieces_of(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """Start, end and the digits of a card or phone that base found there (else empty) of every node.

    Tokens that overlap one base card or phone are one piece.  Of other number
    groups set apart by one blank, those that repeat the last nine digits of such
    a match are one piece; the rest join while the group before has at most 4
    digits and all have at most 19.
    """
    numbers = sorted((s, e) for k, s, e in spans if k >= 2)
    known = [_digits(text[s:e]) for s, e in numbers]
    ends, whole = {d[-9:] for d in known}, set(known)
    out: list[tuple[int, int, str]] = []
    run: list[tuple[int, int]] = []  # number groups, one blank between

    def repeated(last: int, first: int) -> int | None:
        """The group from which groups up to ``last`` repeat a match: all its digits if possible, else the fewest with an area's zero."""
        digits, found = "", None
        for i in range(last, first - 1, -1):
            digits = _digits(text[slice(*run[i])]) + digits
            if len(digits) > 19:
                break
            if digits in whole:
                return i
            if digits[-9:] in ends and (found is None or (found == i + 1 and text[run[i][0]] in "0+(")):
                found = i
        return found

    def join(first: int, last: int) -> None:
        at, size = first, [len(_digits(text[lo:hi])) for lo, hi in run]
        while at < last:
            to, total = at + 1, size[at]
            while to < last and size[to - 1] <= 4 and total + size[to] <= 19:
                total += size[to]
                to += 1
            out.append((run[at][0], run[to - 1][1], ""))
            at = to

    def close() -> None:
        done = 0
        for j in range(len(run)) if ends else ():
            i = repeated(j, done)
            if i is not None:
                join(done, i)
                out.append((run[i][0], run[j][1], ""))
                done = j + 1
        join(done, len(run))
        run.clear()

    k = 0
    for m in _TOKEN.finditer(text):
        word = m[0].rstrip(_EDGES)
        start = m.start() + len(word) - len(word.lstrip(_EDGES))
        word = word.lstrip(_EDGES)
        if not word:
            continue
        end = start + len(word)
        while k < len(numbers) and numbers[k][1] <= start:
            k += 1
        if k < len(numbers) and numbers[k][0] < end:
            close()
            if out and out[-1][2] and numbers[k][0] < out[-1][1]:
                out[-1] = (out[-1][0], end, out[-1][2])
            else:
                out.append((start, end, known[k]))
        elif _NUMBER.fullmatch(word):
            if run and not (run[-1][1] + 1 == start and text[start - 1] == " "):
                close()
            run.append((start, end))
        else:
            close()
            out.append((start, end, ""))
    close()
    return out


def nodes_of(text: str, spans: list[Span]) -> list[Node]:
    pieces = _pieces_of(text, spans)
    ordered = sorted((s, e, k) for k, s, e in spans)
    out: list[Node] = []
    i, before = 0, None
    for start, end, found in pieces:
        while i < len(ordered) and ordered[i][1] <= start and all(e <= start for _, e, _ in ordered[i : i + 4]):
            i += 1
        label = next((k + 1 for s, e, k in ordered[i : i + 8] if s < end and e > start), 0)
        word = text[start:end]
        digits = _digits(word)
        n = len(digits)
        size = next(b for b, top in enumerate((0, 2, 4, 6, 8, 12, 15, 19, 1 << 60)) if n <= top)
        flags = (any(c.isalpha() for c in word), "@" in word, min(3, word.count(".")), "-" in word, " " in word, word[0] in "+(", 13 <= n <= 19 and luhn(digits))
        plain = "".join(c for c in word if c.isalnum()).lower()
        keys = []
        if len(plain) >= 5:
            keys.append("w" + plain)
        if found or (n >= 7 and not flags[0]):
            keys.append("d" + (found or digits)[-9:])
        out.append(Node(start, end, f"{size}:" + "".join(str(int(f)) for f in flags), tuple(keys), before is not None and not text[before:start].strip(), label))
        before = end
    return out


def edges_of(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges of neighbours and skip edges of tokens that share a key, each with the next of its kind and with the first."""
    chain = [(i - 1, i) for i, n in enumerate(nodes) if n.follows]
    skip: set[tuple[int, int]] = set()
    first: dict[str, int] = {}
    latest: dict[str, int] = {}
    for i, node in enumerate(nodes):
        for key in node.keys:
            if key in latest:
                skip |= {(latest[key], i), (first[key], i)}
            first.setdefault(key, i)
            latest[key] = i
    return chain, sorted(skip - set(chain))


def counts_of(text: str) -> Counter:
    """What a document adds to the training counts."""
    nodes = nodes_of(text, base_spans(text))
    chain, skip = edges_of(nodes)
    total = Counter(("u", n.shape, n.label, 0) for n in nodes)
    total.update(("c", "", nodes[a].label, nodes[b].label) for a, b in chain)
    total.update(("s", "", nodes[a].label, nodes[b].label) for a, b in skip)
    return total


@dataclass
class Field:
    """Log potentials: of each shape and label, of neighbours, of similar tokens."""

    shapes: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int, int, int]]) -> Field:
        """Piecewise maximum likelihood from counts, smoothed towards no label."""
        shapes: dict[str, np.ndarray] = {}
        pairs = {"c": np.full((LABELS, LABELS), 0.05), "s": np.full((LABELS, LABELS), 0.05)}
        for m in pairs.values():
            m += np.eye(LABELS)
        for kind, shape, a, b, n in counts:
            if kind == "u":
                shapes.setdefault(shape, np.array([1.0] + [0.02] * (LABELS - 1)))[a] += n
            else:
                pairs[kind][a, b] += n / 2
                pairs[kind][b, a] += n / 2
        ratio = {k: np.clip(np.log(m * m.sum() / np.outer(m.sum(axis=1), m.sum(axis=0))), -4, 4) for k, m in pairs.items()}
        return cls({s: np.log(c / c.sum()) for s, c in shapes.items()}, ratio["c"], ratio["s"])

    def unary(self, nodes: list[Node]) -> np.ndarray:
        unseen = np.log(np.array([0.92] + [0.02] * (LABELS - 1)))
        out = np.array([self.shapes.get(n.shape, unseen) for n in nodes]).reshape(len(nodes), LABELS)
        for i, n in enumerate(nodes):
            if n.label:  # base matches are observed
                out[i] = -30.0
                out[i, n.label] = 0.0
        return out

    def marginals(self, unary: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Loopy sum-product over all edges at once."""
        edges = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        if len(edges):
            weights = np.concatenate([np.repeat(self.chain[None], len(chain), axis=0), np.repeat(self.skip[None], len(skip), axis=0)])
            source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
            weights = np.concatenate([weights, weights.transpose(0, 2, 1)])
            back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
            message = np.zeros((len(source), LABELS))
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, target, message)
                sent = (belief[source] - message[back])[:, :, None] + weights
                top = sent.max(axis=1, keepdims=True)
                new = np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                step = np.abs(new - message).max()
                message = damping * message + (1 - damping) * new
                if step < 1e-4:
                    break
            belief = unary.copy()
            np.add.at(belief, target, message)
        else:
            belief = unary
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def find(texts: list[str], field: Field, least: float = 0.5) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text; one message passing serves all texts."""
    base = [base_spans(t) if _HINT.search(t) else [] for t in texts]
    every: list[Node] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        nodes = nodes_of(text, base[i]) if _HINT.search(text) else []
        if all(n.label for n in nodes):  # nothing left to decide
            continue
        c, s = edges_of(nodes)
        k = len(every)
        chain += [(a + k, b + k) for a, b in c]
        skip += [(a + k, b + k) for a, b in s]
        every += nodes
        owner += [i] * len(nodes)
    added: list[list[Span]] = [[] for _ in texts]
    if every:
        p = field.marginals(field.unary(every), chain, skip)
        best = p.argmax(axis=1)
        for j in np.flatnonzero((best > 0) & (p[np.arange(len(p)), best] >= least)):
            if not every[j].label:
                added[owner[j]].append((int(best[j]) - 1, every[j].start, every[j].end))
    return list(zip(base, added))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def train(docs: DataFrame, text_col: str = "text") -> Field:
    """A field from the counts of all documents; shapes are few hundred strings, whatever the input."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and _HINT.search(text):
                    total += counts_of(text)
        columns = list(zip(*[(*k, n) for k, n in sorted(total.items())])) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "shape", "a", "b", "n"])

    counts = docs.select(F.col(text_col)).mapInArrow(work, "kind string, shape string, a int, b int, n long").groupBy("kind", "shape", "a", "b").agg(F.sum("n").alias("n"))
    return Field.fit(sorted(map(tuple, counts.collect())))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``.

    Base matches stay and are observed labels of the field.  Other tokens with a
    digit or an at sign get a label where its probability, after messages between
    neighbours and between equal or similar tokens of the document, is a half or
    more.  Null and empty texts have no spans (empty string).  Repeated rows each
    count; an empty table gives no rows; other columns are not read.
    """
    field = field or train(docs, text_col)
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = find([t or "" for t in part.column("text").to_pylist()], field)
                per_kind = [Counter(k for k, _, _ in base) for base, _ in found]
                numbers = [pa.array([c[k] for c in per_kind], pa.int64()) for k in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([_joined(base + more) for base, more in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), *numbers, digest, spans], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    fields = [T.StructField("id", kind), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    done = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, T.StructType(fields))
    return done.withColumnRenamed("id", id_col)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    if not spans:
        return text
    out, last = [], 0
    for start, end, kind in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1])):
        if start >= last:
            out += [text[last:start], _MASKS[kind]]
            last = end
    return "".join([*out, text[last:]])


def mask_documents(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in the text; all other columns pass as they are."""
    field = field or train(docs, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col).to_pylist()
                new = [masked(t, base + more) for t, (base, more) in zip(texts, find([t or "" for t in texts], field))]
                i = part.schema.get_field_index(text_col)
                yield part.set_column(i, part.schema.field(i), pa.array(new, part.schema.field(i).type))

    return docs.mapInArrow(work, docs.schema)
