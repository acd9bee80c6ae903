"""Range joins, bucketed tables, plate checks and updates that repeat keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wellspark.operators import plates as pl, sinks
from wellspark.operators.buckets import BucketedTable


def test_ten_thousand_rectangles_meet_only_their_bins(spark):
    r = random.Random(4)
    cells = spark.range(1000 * 60).select(F.lit("f").alias("file"), F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), F.col("id").cast("string").alias("cell"))
    rects = [("f", i, a := r.randrange(1000), a + r.randrange(12), b := r.randrange(60), b + r.randrange(8)) for i in range(10_000)]
    df = spark.createDataFrame(rects, "file string, n int, start_row int, end_row int, start_col int, end_col int")
    got = pl.cut_blocks(cells, df).groupBy("n").agg(F.count("*").alias("k"), F.sum(F.col("cell").cast("long")).alias("s"))
    want = {}
    for _, n, a, b, c, d in rects:
        inside = [x * 60 + y for x in range(a, min(b, 999) + 1) for y in range(c, min(d, 59) + 1)]
        want[n] = (len(inside), sum(inside))
    assert {x.n: (x.k, x.s) for x in got.collect()} == want
    assert pl.binned_join(cells, df).count() <= 12 * sum(k for k, _ in want.values()) < 10_000 * 60_000 / 100


def test_rectangles_turned_inside_out_and_empty_tables(spark):
    cells = spark.createDataFrame([("f", 1, 1, "x"), ("g", 0, 0, "y")], "file string, row int, col int, cell string")
    schema = "file string, start_row int, end_row int, start_col int, end_col int"
    df = spark.createDataFrame([("f", 5, 2, 0, 9), ("f", 0, 40, 1, 1), ("h", 0, 9, 0, 9)], schema)
    assert [tuple(r) for r in pl.cut_blocks(cells, df).collect()] == [("f", 1, 0, "x")]
    assert pl.cut_blocks(cells, spark.createDataFrame([], schema)).count() == 0


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_an_upsert_rewrites_the_buckets_it_hits(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), ["k"], "at", 16)
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("at"), F.lit("old").alias("v"))
    t.create(rows)
    before = files_of(tmp_path)
    updates = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, 2, "B"), (5000, 1, "new"), (7, -1, "late")], "k long, at long, v string")
    hit = t.upsert(updates, "one")
    assert 1 <= len(hit) <= 2 and before.items() <= files_of(tmp_path).items()
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 2001 == t.read().count() and got[7] in ("b", "B") and got[5000] == "new" and got[8] == "old"
    after = files_of(tmp_path)
    assert t.upsert(updates, "one") == [] and files_of(tmp_path) == after
    assert t.upsert(updates.filter("false"), "two") == [] and t.read().count() == 2001
    t.upsert(spark.createDataFrame([(7, 9, "c")], "k long, at long, v string"), "three")
    assert {r.v for r in t.read().filter("k = 7").collect()} == {"c"} and t.read().count() == 2001


def test_a_commit_without_manifest_is_not_seen(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), ["k"], "at", 4)
    t.create(spark.createDataFrame([(1, 1, "a")], "k long, at long, v string"))
    t._write(spark.createDataFrame([(1, 5, "lost")], "k long, at long, v string"), "broken")
    assert [r.v for r in t.read().collect()] == ["a"]
    t.upsert(spark.createDataFrame([(1, 6, "kept")], "k long, at long, v string"), "broken")
    assert [r.v for r in t.read().collect()] == ["kept"]


def test_updates_that_repeat_a_key_do_not_multiply_rows(spark):
    target = spark.createDataFrame([(1, "x", True), (2, "y", True)], "id long, name string, ok boolean")
    updates = spark.createDataFrame([(1, "late", 1), (1, "latest", 2), (1, "early", 0)], "id long, name string, at long")
    assert sorted(tuple(r) for r in sinks.apply_updates(target, updates, ["id"], "at").collect()) == [(1, "latest", True), (2, "y", True)]
    assert sinks.apply_updates(target, updates.drop("at"), ["id"]).count() == 2


@pytest.mark.parametrize("expected, wells", [(96, ["A1", "H12", "I1"]), (384, ["A1", "P24", "A25"])])
def test_plate_columns_are_checked_in_one_pass(spark, expected, wells):
    rows = [("p", wells[0], 1.0, None), ("p", wells[0], None, None), ("p", wells[1], None, "x"), ("p", wells[2], None, None), (None, None, 2.0, "y")]
    got = {(r.plate_id, r.column): r for r in pl.check_plate_columns(spark.createDataFrame(rows, "plate_id string, well_id string, v double, w string"), expected=expected).collect()}
    assert (got["p", "v"].n_rows, got["p", "v"].n_wells, got["p", "v"].n_bad, got["p", "v"].n_missing) == (4, 3, 1, 3)
    assert "Column 'v' has 75.0% missing data" in got["p", "v"].warnings and f"Expected {expected} wells, found 3" in got["p", "w"].warnings
    assert got[None, "v"].n_missing == 0 and got["p", "v"].is_valid
    bare = pl.check_plate_columns(spark.createDataFrame([("A1", 1)], "well_id string, v int")).collect()
    assert not bare[0].is_valid and "Missing required column: plate_id" in bare[0].warnings
