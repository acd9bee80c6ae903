"""Chunked ordered operators against plain Python on small inputs, with tiny chunks and hot keys."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wellspark.functions.ordered import count_since_reset, fill_forward, int_chunk, number_rows, sessionize

ROWS = st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", None]), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=40)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)


def frame(spark, rows):
    unique = {(k, at): v for k, at, v in rows}
    data = [(k, at, v) for (k, at), v in unique.items()]
    return data, spark.createDataFrame(data, "k string, at bigint, v int")


def by_key(data):
    groups = {}
    for k, at, v in data:
        groups.setdefault(k, []).append((at, v))
    return {k: sorted(g, key=lambda x: x[0]) for k, g in groups.items()}


@SETTINGS
@given(ROWS)
def test_number_rows(spark, rows):
    data, df = frame(spark, rows)
    got = {(r.k, r.at): r.n for r in number_rows(df, ["k"], [F.col("at")], int_chunk("at", 7), "n").collect()}
    assert got == {(k, at): i for k, g in by_key(data).items() for i, (at, _) in enumerate(g)}


@SETTINGS
@given(ROWS)
def test_fill_forward_and_backward(spark, rows):
    data, df = frame(spark, rows)
    ahead = fill_forward(df, ["k"], ["at"], int_chunk("at", 5), {"f": F.col("v")})
    both = fill_forward(ahead, ["k"], ["at"], int_chunk("at", 5), {"b": F.col("v")}, backward=True)
    got = {(r.k, r.at): (r.f, r.b) for r in both.collect()}
    want = {}
    for k, g in by_key(data).items():
        for i, (at, _) in enumerate(g):
            f = next((v for _, v in reversed(g[: i + 1]) if v is not None), None)
            b = next((v for _, v in g[i:] if v is not None), None)
            want[(k, at)] = (f, b)
    assert got == want


@SETTINGS
@given(ROWS)
def test_count_since_reset(spark, rows):
    data, df = frame(spark, rows)
    counted, reset = F.coalesce(F.col("v") < 7, F.lit(False)), F.coalesce(F.col("v") >= 7, F.lit(False))
    got = {(r.k, r.at): r.n for r in count_since_reset(df, ["k"], [F.col("at")], int_chunk("at", 6), counted, reset, "n").collect()}
    want = {}
    for k, g in by_key(data).items():
        n = 0
        for at, v in g:
            n = 0 if v is not None and v >= 7 else n + (v is not None)
            want[(k, at)] = n
    assert got == want


def test_hot_key_is_spread_over_chunks(spark):
    """One key with nearly all rows: its chunks, not the key, are the unit of the window."""
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("at"))
    out = number_rows(df, ["k"], [F.col("at")], int_chunk("at", 100), "n")
    assert out.filter("k = 'hot'").agg(F.max("n")).first()[0] == 4899
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__chunk" in plan


@pytest.mark.parametrize("chunk", [60, 3600, 10**9])
def test_sessionize(spark, chunk):
    rng = random.Random(7)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([5, 60, 700, 1799, 1800, 1801, 4000])
        rows.append(("u" if i % 3 else "w", t, i))
    df = spark.createDataFrame(rows, "u string, s bigint, i int").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = sorted((r.u, r.n_events) for r in sessionize(df, ["u"], "ts", "i", 1800, chunk).collect())
    want = []
    for u in ("u", "w"):
        times = [t for k, t, _ in rows if k == u]
        n = 0
        for a, b in zip([None, *times], times):
            if a is not None and b - a >= 1800:
                want.append((u, n))
                n = 0
            n += 1
        want.append((u, n))
    assert got == sorted(want)
