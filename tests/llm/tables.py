"""Small tables with everything that may go wrong: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "id size key fp start end kind match own th node component rep x y score rank piece length part uid label code n spans words target _key _service _size _n".split()


def documents(spark, rows, clash=True):
    """Rows of (doc_id, text, lang, source), with columns of names the operators use inside."""
    df = spark.createDataFrame([(i, t, l, s, len(t) if t is not None else None) for i, t, l, s in rows], SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}) if clash else df


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    long = " ".join(words(1, 30_000, 5000))
    shared = " ".join(words(2, 60))
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None), (4, "one", "fr", "b"), (5, "one", "fr", "b"), (5, "one", "fr", "b"),
        (6, long, "en", "a"), (7, f"{shared} tail", "de", "c"), (8, f"head {shared}", "de", None), (9, "a " * 200, "es", "a"), (None, shared, None, "a"), (None, None, None, None),
        (10, "É naïve 😀 x\x1cy z", "fr", "b"), (11, f"{shared} tail", "de", "c"), (12, "x" * 50_000, "en", "a"), (-3, f"{shared} tail", "de", "c"),
    ]


def as_sets(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows)
