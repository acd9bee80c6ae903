"""Named queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common table expressions the SQL twins may use; definition order is dependency order.
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


def _needed(body: str) -> list[str]:
    found: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", pending.pop()))
        for name in VIEWS:
            if name in words and name not in found:
                found.add(name)
                pending.append(VIEWS[name])
    return [n for n in VIEWS if n in found]


def with_views(body: str) -> str:
    """Prefix a SELECT with the views it mentions, directly or through others."""
    names = _needed(body)
    if not names:
        return body
    # A view named more than once is worked out once.
    mentions = Counter(w for text in (body, *(VIEWS[n] for n in names)) for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if mentions[n] > 1 else ''}({VIEWS[n]})" for n in names)
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{body.lstrip()[len('WITH '):]}"
    return f"WITH {head}\n{body}"


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and times without zone, as in the SQL twin."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql.strip())
        return fn

    return register
