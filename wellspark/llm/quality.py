"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wellspark.llm.batches import flat_utf8, learned_apart, slices
from wellspark.session import settle

#: Byte classes of the statistics; all other bytes of printable ASCII are symbols.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r\v\f", "line": b"\n", "stop": b".,;:'\"()", "shout": b"!?", "bar": b"|/\\<>[]{}"}
NAMES = [*CLASSES, "symbol", "high"]
KINDS = len(NAMES)
_LUT = np.full(256, NAMES.index("symbol"), np.uint8)
_LUT[128:] = NAMES.index("high")
for _i, _members in enumerate(CLASSES.values()):
    _LUT[list(_members)] = _i
WORD_STATS = 10
STATS = KINDS + WORD_STATS
FEATURES = 384
#: Raw scores are counted in this many steps for the calibration.
STEPS = 1024


def word_statistics(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * WORD_STATS
    lines = [x for x in text.split(b"\n") if x]
    lengths = list(map(len, words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    endings = [w[-1] for w in words]
    marked = sum(e in b"#$%&*!|" for e in endings)
    return [
        np.log1p(n), sum(lengths) / n, np.log1p(max(lengths)), len(set(words)) / n, same / n, np.log1p(len(lines)),
        len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), marked / n, len(set(endings)) / min(n, 64),
    ]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text; a null text counts as empty and gives zeros."""
    data, offsets = flat_utf8(column)
    n = len(column)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64) * KINDS, sizes)
    counts = np.bincount(owner + _LUT[data], minlength=n * KINDS).reshape(n, KINDS)
    raw = data.tobytes()
    words = np.array([word_statistics(raw[lo:hi]) for lo, hi in zip(offsets, offsets[1:])], np.float64).reshape(n, WORD_STATS)
    return np.hstack([np.sqrt(counts / np.maximum(sizes, 1)[:, None]), words])


@dataclass
class Model:
    """Everything a task needs to score texts; a few hundred kilobytes whatever the input."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the Fourier features and a constant
    steps: np.ndarray  # raw score and calibrated score, ascending
    values: np.ndarray
    seed: int = 11

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.spread, self.seed)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.steps, self.values), 0.0, 1.0)


def fourier(x: np.ndarray, seed: int, count: int = FEATURES) -> np.ndarray:
    """Features whose inner products approximate exp(-|x - y|^2 / (2 d)), and a constant."""
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((x.shape[1], count)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, count)
    return np.hstack([np.sqrt(2 / count) * np.cos(np.clip(x, -8, 8) @ w + b), np.ones((len(x), 1))])


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing shares for ordered groups, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for n, p in zip(total, positive):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, p2, k2 = blocks.pop()
            blocks[-1][0] += n2
            blocks[-1][1] += p2
            blocks[-1][2] += k2
    return np.concatenate([np.full(int(k), p / n) for n, p, k in blocks]) if blocks else np.zeros(0)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``x``, the statistics of the whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATS, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), values], ["id", "x"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATS)


def _sums(model: Model):
    """Z'Z and Z'y of a partition, one row for each feature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x, y = _rows(batch.column("x")), batch.column("y").to_numpy()
            for lo in range(0, len(y), 4096):
                z = model.features(x[lo : lo + 4096])
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ y[lo : lo + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    return work


def _added(key: tuple, table: pa.Table) -> pa.Table:
    rows = [np.frombuffer(r, np.float64) for r in table.column("row").to_pylist()]
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})


def learn(statistics_: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", parts: int = 5, held_out: int = 0, penalty: float = 1e-3) -> Model:
    """A model from all labelled rows outside the held-out fold; a fifth of the ids (fold 4) calibrates, the others fit.

    Labels other than 0 and 1 are not used; an id labelled twice counts with the
    mean.  Without labels of both kinds the score is the share of label 1, 0.5
    without labels.
    """
    # fmt: off
    marks = labels.select(F.col(id_col).alias("_of"), F.col(label_col).cast("double").alias("y")).filter("y in (0, 1)").groupBy("_of").agg(F.avg("y").alias("y"))
    known = statistics_.filter(~learned_apart(F.col("id"), parts, held_out)).join(marks, F.col("id") == F.col("_of")).select("id", "x", "y")
    # fmt: on
    known = settle(known, "labelled")
    n, share, *moments = known.agg(F.count("*"), F.avg("y"), *[f(F.col("x")[i]) for i in range(STATS) for f in (F.avg, F.stddev_pop)]).first()
    if not n or share in (0.0, 1.0):
        value = float(share) if n else 0.5
        return Model(np.zeros(STATS), np.ones(STATS), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([value, value]))
    mean, spread = np.array(moments[::2], np.float64), np.array(moments[1::2], np.float64)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    calibrates = learned_apart(F.col("id"), parts, parts - 1)
    sums = known.filter(~calibrates).mapInArrow(_sums(model), "i int, row binary").groupBy("i").applyInArrow(_added, "i int, row binary").collect()
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, row in sums:
        total[i] = np.frombuffer(row, np.float64)
    ridge = penalty * max(1.0, total[-1, -2]) / FEATURES * np.eye(FEATURES + 1)
    model.weights = np.linalg.solve(total[:, :-1] + ridge, total[:, -1])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.features(_rows(batch.column("x"))) @ model.weights
            step = np.clip((raw + 0.5) / 2 * STEPS, 0, STEPS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("y")], ["step", "y"])

    counted = known.filter(calibrates).mapInArrow(stepped, "step int, y double").groupBy("step").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("p")).orderBy("step").collect()
    if not counted:  # too few rows for a fold of their own
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    step, n_of, p_of = (np.array(v, np.float64) for v in zip(*counted))
    model.steps, model.values = (step + 0.5) / STEPS * 2 - 0.5, isotonic(n_of, p_of)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held_out: int = 0, cut: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Null and empty texts have statistics of zero and are scored like others; a
    null id is scored and never learned from.  Repeated rows are scored each.  An
    empty table gives no rows.  Only the text decides a score; other columns are
    not read.
    """
    stats = settle(document_statistics(docs, id_col, text_col), "statistics")
    model = learn(stats, labels, id_col, parts=parts, held_out=held_out)
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(_rows(batch.column("x"))))], ["id", "score"])

    scored = stats.mapInArrow(work, T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), learned_apart(F.col("id"), parts, held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows whose text scores below ``cut``; all columns pass as they are."""
    model = learn(settle(document_statistics(docs, id_col, text_col), "statistics"), labels, id_col, **options)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.score(statistics(part.column(text_col))) >= cut))

    return docs.mapInArrow(work, docs.schema)
