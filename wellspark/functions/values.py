"""Cell-level conversions shared by every operator: numbers, times, missing values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# What counts as a missing cell, and what a number looks like.
NULL_TOKENS = ["", "N/A", "NaN", "null", "NULL", "-", "missing", "n/a"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
EXTRA_TIME_FORMATS = ["MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Without it every mention repeats the whole expression tree.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(c: Column | str, piece: str) -> Column:
    """How often a (single-character) piece occurs in a text."""
    c = col_(c)
    return F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))


def point_decimal(c: Column | str) -> Column:
    """``1,5`` becomes ``1.5``; text that already has a point stays as it is."""
    t = F.trim(col_(c))
    return F.when(F.contains(t, F.lit(",")) & ~F.contains(t, F.lit(".")), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)


def is_num(c: Column | str) -> Column:
    return F.coalesce(point_decimal(c).rlike(NUMBER), F.lit(False))


def to_num(c: Column | str) -> Column:
    """DOUBLE of a US or decimal-comma number, NULL for anything else.

    The pattern guards the cast: a bare cast would accept suffixes such as ``1d``.
    """
    t = point_decimal(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def null_token(c: Column | str) -> Column:
    t = F.trim(col_(c))
    return F.when(~t.isin(NULL_TOKENS), t)


def parse_time(c: Column | str, formats: list[str] | None = None) -> Column:
    """TIMESTAMP from ISO text or one of a list of formats; NULL when none fits.

    Zone offsets in the text are honoured; text without one is in session time.
    """
    t = F.trim(col_(c))
    iso = F.when(t.rlike(ISO_DATE), t.try_cast("timestamp"))
    others = [F.try_to_timestamp(t, F.lit(f)) for f in (EXTRA_TIME_FORMATS if formats is None else formats)]
    looks_like_time = t.rlike(r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")
    return F.when(looks_like_time, F.coalesce(iso, *others))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column | str, pieces: list[str]) -> Column:
    c = col_(c)
    return any_of([F.contains(c, F.lit(p)) for p in pieces])
