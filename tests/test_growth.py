"""Work that has to stay spread, or in place, however large the tables are."""

import re

from pyspark.sql import functions as F

from wellspark.functions import ordered
from wellspark.operators import plates as pl, protocols as pr, structure as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scopes_are_dealt_before_they_are_opened(spark):
    rows = [(f"p{i}", 1, 8, 1, 12, "brand", f"b{i}") for i in range(40)] + [(None, 2, 2, 3, 4, "kind", None)]
    scopes = spark.createDataFrame(rows, "plate_id string, row_from int, row_to int, col_from int, col_to int, field string, value string").coalesce(1)
    opened = pr.expand_scopes(scopes)
    assert opened.rdd.getNumPartitions() == 4 and opened.count() == 40 * 96 + 2
    assert sorted({r.well_id for r in opened.filter("plate_id is null").collect()}) == ["B3", "B4"]


def test_names_meet_cells_without_a_sort_by_file(spark):
    cells = spark.range(300).selectExpr("'f' as file", "cast(id div 3 as int) as row", "cast(id % 3 as int) as col", "if(id = 1, '', concat('c', id)) as cell").repartition(3)
    known = spark.createDataFrame([("f", 0, 1), ("g", 0, 1)], "file string, header_row int, data_start int")
    named = st.named_cells(cells, known)
    assert "SortMergeJoin" not in plan(named)
    assert {(r.col, r.name) for r in named.collect()} == {(0, "c0"), (1, "col_1"), (2, "c2")} and named.count() == 297


def test_rectangles_that_crowd_in_a_bin_are_dealt_over_parts(spark):
    cells = spark.range(64).selectExpr("'f' as file", "id div 8 as row", "id % 8 as col", "id as cell").coalesce(1)
    rects = spark.range(5000).selectExpr("'f' as file", "id as n", "id % 4 as start_row", "id % 4 + 3 as end_row", "id % 3 as start_col", "id % 3 + 9 as end_col")
    joined = pl.binned_join(cells, rects)
    assert "SortMergeJoin" in plan(joined) and "_part" in plan(joined) and joined.columns == ["file", "_rb", "_cb", "row", "col", "cell", "n", "start_row", "end_row", "start_col", "end_col"]
    got = {r.n: (r.k, r.s) for r in pl.cut_blocks(cells, rects).groupBy("n").agg(F.count("*").alias("k"), F.sum("cell").alias("s")).collect()}
    inside = lambda n: [r * 8 + c for r in range(n % 4, min(n % 4 + 3, 7) + 1) for c in range(n % 3, 8)]
    assert got == {n: (len(inside(n)), sum(inside(n))) for n in range(5000)}


def test_rows_along_a_file_move_once(spark):
    rows = [(f, i, i % 7 == 0) for f in ("a", None) for i in range(100)]
    df = spark.createDataFrame(rows, "file string, n long, on boolean")
    filled = ordered.fill_forward(df, ["file"], ["n"], ordered.int_chunk("n", 10), {"at": F.when(F.col("on"), F.col("n"))})
    read = ordered.scan_two_states(df, ["file"], ["n"], ordered.int_chunk("n", 10), F.col("on"), ~F.col("on"), "s")
    for out in (filled, read):
        keys = re.findall(r"Exchange hashpartitioning\((.*), 4\)", re.sub(r"#\d+L?", "", plan(out)))
        assert "__chunk" in keys and not any("coalesce" in k for k in keys)
    assert all(r.at == r.n - r.n % 7 for r in filled.collect()) and filled.count() == 200
    states = {(r.file, r.n): r.s_after for r in read.collect()}
    for f in ("a", None):
        now = 0
        for i in range(100):
            now = int((i % 7 == 0) != bool(now))
            assert states[f, i] == now
