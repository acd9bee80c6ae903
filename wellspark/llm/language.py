"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wellspark.llm.batches import flat_utf8, learned_apart, slices

#: Families by ISO 639-1 code.  A language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic", "hr": "slavic",
}
BUCKET_BITS = 11
BUCKETS = 1 << BUCKET_BITS
#: Documents learned from in each language: those with the smallest hashes of id and text.
PER_LANGUAGE = 500
LETTER = regex.compile(r"\p{L}")


def profiles(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed letter trigrams in each lower-cased text."""
    data, offsets = flat_utf8(pc.utf8_lower(column))
    n, sizes = len(column), np.diff(offsets)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    byte = np.where(letter, data, 32).astype(np.uint32)
    before, after = np.roll(byte, 1), np.roll(byte, -1)
    filled = sizes > 0
    before[offsets[:-1][filled]] = 32
    after[offsets[1:][filled] - 1] = 32
    at = np.flatnonzero(letter)
    key = before[at] * np.uint32(2654435761) + byte[at] * np.uint32(2246822519) + after[at] * np.uint32(3266489917)
    key = (key ^ (key >> np.uint32(15))) * np.uint32(668265263)
    bucket = (key >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, sizes)[at]
    counts = np.bincount(owner + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge loss, balanced classes) by accelerated gradient descent."""
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(z.dtype)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(z.dtype)
    w = np.zeros(z.shape[1], z.dtype)
    ahead, step, t = w.copy(), float(1 / (2 * (z**2).sum(axis=1).max() + penalty)), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        gradient = penalty * ahead - 2 * (weight * slack * y) @ z
        new = ahead - step * gradient
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * v, -30, 30)))


@dataclass
class Model:
    """Weights of the family stage and of each pair of languages within a family."""

    families: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, languages: list[str], names: dict[str, str]) -> Model:
        known = sorted(set(languages))
        families: dict[str, list[str]] = {}
        for lang in known:
            families.setdefault(names.get(lang, f"only {lang}"), []).append(lang)
        lang = np.array(languages)
        stage = [linear_svm(x, np.where(np.isin(lang, m), 1.0, -1.0)) for m in families.values()] if len(families) > 1 else []
        model = cls(families, np.array(stage).reshape(len(stage), BUCKETS + 1))
        for members in families.values():
            for a, b in combinations(members, 2):
                own = (lang == a) | (lang == b)
                model.pairs[a, b] = linear_svm(x[own], np.where(lang[own] == a, 1.0, -1.0))
        return model

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each profile: the family's share times the mean share of won pairs."""
        z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        names = list(self.families)
        margin = z @ self.family_weights.T if len(names) > 1 else np.zeros((len(x), 1))
        share = _sigmoid(margin)
        share /= share.sum(axis=1, keepdims=True)
        family, labels, score = margin.argmax(axis=1), np.empty(len(x), object), np.zeros(len(x))
        for f, name in enumerate(names):
            rows = np.flatnonzero(family == f)
            members = self.families[name]
            won, part = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                v = z[rows] @ self.pairs[a, b]
                p = _sigmoid(v)
                won[:, i] += v >= 0
                won[:, j] += v < 0
                part[:, i] += p
                part[:, j] += 1 - p
            part /= max(1, len(members) - 1)
            best = np.argmax(won + part / 10, axis=1) if len(members) > 1 else np.zeros(len(rows), np.int64)
            labels[rows] = np.array(members, object)[best]
            score[rows] = share[rows, f] * (part[np.arange(len(rows)), best] if len(members) > 1 else 1.0)
        return labels.tolist(), np.clip(score, 0, 1)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, parts: int, held_out: int, per_language: int, families: dict[str, str]) -> Model | None:
    """A model from at most ``per_language`` documents of each language outside the held-out fold; None without any."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~learned_apart(F.col("id"), parts, held_out))
    # By id and text: other texts of a repeated id are rows of their own, and copies of a row count once.
    own = own.withColumn("place", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)))
    # One number for each language, as in the model: rows beyond it are passed over before any shuffle, and at most about twice the rows wanted meet.
    below = [(r["lang"], 2.0 * per_language * (1 << 40) / r["n"]) for r in own.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()]
    limit = F.try_element_at(F.create_map(*[F.lit(x) for pair in below or [("", 0.0)] for x in pair]), F.col("lang"))
    few = own.select("lang", "place").filter(F.col("place") <= limit).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = few.withColumn("n", first).filter(F.col("n") <= per_language).select("lang", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                x = profiles(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("lang"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["place", "lang", "x"])

    # At most per_language places for each language of the model are broadcast, so the texts stay where they are.
    found = own.join(F.broadcast(chosen), ["lang", "place"], "left_semi").select("place", "text", "lang").mapInArrow(work, "place long, lang string, x binary")
    rows = found.dropDuplicates(["place", "lang"]).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["place"], r["x"]))
    return Model.fit(np.array([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), [r["lang"] for r in rows], families)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE, families: dict[str, str] = FAMILIES
) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``lang_pred``, ``score``.

    A null text or one without a letter is ``und`` with score 0; so is every text
    if there is nothing to learn from.  Whole texts are read; equal texts get
    equal answers.  A null id is predicted and never learned from.  An empty
    table gives no rows; other columns are not read.
    """
    model = learn(docs, id_col, text_col, lang_col, parts, held_out, per_language, families)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                some = [t is not None and model is not None and LETTER.search(t) is not None for t in part.column("text").to_pylist()]
                label, score = model.predict(profiles(part.column("text"))) if model else (["und"] * len(some), np.zeros(len(some)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([v if s else "und" for v, s in zip(label, some)], pa.string()), pa.array(np.where(some, score, 0.0))], ["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    done = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
    return done.select(F.col("id").alias(id_col), learned_apart(F.col("id"), parts, held_out).alias("held_out"), "lang_pred", "score")
