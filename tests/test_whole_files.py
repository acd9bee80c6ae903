"""Facts come from whole files, and nothing is lost or cut on the way."""

import pytest
from pyspark.sql import functions as F

from wellspark.operators import cleaning as cl, logs as lg, plates as pl, protocols as pr, reports as rp, structure as st


def lines(spark, **files):
    rows = [(name, i, line) for name, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


def by_file(df, column):
    return {r["file"]: r[column] for r in df.collect()}


def test_delimiter_of_a_file_with_a_long_odd_head(spark):
    odd = "\n".join(["# a; b; c"] * 25 + ["1,2,3,4"] * 500)
    df = lines(spark, odd=odd, blank_head="\n" * 25 + "1;2;3", blank="\n\n", uneven="a,b\nc,d,e\nf,g,h,i")
    assert by_file(st.detect_delimiter(df), "delimiter") == {"odd": ",", "blank_head": ";", "blank": ",", "uneven": ","}
    assert by_file(st.detect_delimiter_by_count(df), "delimiter")["odd"] == ","
    assert st.to_cells(df, st.detect_delimiter(df)).filter("file = 'blank_head'").count() == 3


def test_block_end_is_found_anywhere(spark):
    row = ",".join(["1.5"] * 12)
    df = lines(spark, long="\n".join(["label", *[row] * 40, "Notes: end", row]), open="\n".join(["label", *[row] * 3]), narrow="\n".join(["label", *[row] * 50, "1,2", row]))
    found = st.detect_delimiter(df)
    blocks = st.data_block(df, found, st.data_start(df, found, st.header_rows(df)))
    assert by_file(blocks, "data_end") == {"long": 41, "open": 4, "narrow": 51}
    assert by_file(st.detect_uniform_delimiter(df, blocks), "n_cols") == {"long": 12, "open": 12, "narrow": 12}


def test_wide_files_keep_their_columns_and_narrow_ones_are_reported(spark):
    df = lines(spark, wide=",".join(map(str, range(80))), narrow="alone\nalone")
    cells = st.to_cells(df, st.detect_delimiter(df))
    kept = st.apply_shape_rules(cells)
    assert kept.count() == 80 and {(r.n_cols, r.wide) for r in kept.select("n_cols", "wide").collect()} == {(80, True)}
    assert [tuple(r) for r in st.rejected_files(cells).collect()] == [("narrow", 2, "fewer than two columns")]


def test_labels_and_headers_far_down(spark):
    df = lines(spark, late="\n".join(["x"] * 20 + ["Plate ID 7", "1 2 3 4 5"]))
    assert by_file(st.plate_label_row(df), "plate_id_row") == {"late": 20}
    assert by_file(st.header_rows(df), "header_rows") == {"late": 21}


def test_wells_of_two_files_stay_apart(spark):
    long = spark.createDataFrame([("a", "Unknown", "A1", "protocol_dose", "1"), ("b", "Unknown", "A1", "protocol_dose", "2")], "file string, plate_id string, well_id string, field string, value string")
    assert sorted(map(tuple, pr.widen(long, ["protocol_dose"]).collect())) == [("a", "Unknown", "A1", "1"), ("b", "Unknown", "A1", "2")]


def test_every_bad_well_is_listed(spark):
    wells = spark.createDataFrame([("P", f"Z{i % 9}") for i in range(18)] + [("P", "A1"), ("P", None)], "plate_id string, well_id string")
    assert {r.well_id: r.n_rows for r in pl.bad_wells(wells).collect()} == {f"Z{i}": 2 for i in range(9)} | {None: 1}


def test_comparison_signs_and_entities_stay(spark):
    df = spark.createDataFrame([("p < 0.05 and n > 3",), ("a &lt; b & c",), ("<b>x</b><!-- y -->z",), ("y" * 3000,)], "t string")
    got = [r[0] for r in df.select(cl.sanitize_string(F.col("t"))).collect()]
    assert got == ["p &lt; 0.05 and n &gt; 3", "a &lt; b &amp; c", "xz", "y" * 3000]


def test_reports_end_at_their_moment(spark):
    at = rp.AsOf.of("2024-01-20 09:30:00")
    rows = [("2024-01-19 10:00:00", 2.0), ("2024-01-20 08:00:00", 1.0), ("2024-01-20 10:00:00", 4.0), ("2024-01-25 00:00:00", 8.0)]
    usage = spark.createDataFrame(rows, "t string, metric_value double").select(
        F.lit(1).alias("organization_id"), F.lit("m").alias("metric_type"), F.to_timestamp_ntz("t").alias("timestamp"), "metric_value", F.lit(1).alias("user_id")
    )
    now = rp.current_usage(usage, at).first()
    assert (now.today_total, now.month_total) == (5.0, 3.0)
    assert rp.usage_summary(usage, at).first().total_value == pytest.approx(3.0)


def test_no_log_file_is_lost(spark):
    """With a time, without one, with a broken one, and without its header line: in = out + quarantine."""
    df = lines(spark, timed="timestamp,v\n2024-01-01 00:00:00,1\nlate,2", untimed="a,b\nx,y\nz,w", headless="only")
    annotation = spark.createDataFrame([("timed", 0, 1), ("untimed", 0, 1), ("headless", 3, 0)], "file string, header_row int, data_start int")
    unknown = spark.createDataFrame([("timed", ",")], "file string, delimiter string")
    timed = lg.with_time(df, lg.file_facts(df, unknown, annotation), prefix=False)
    good, bad = lg.split_bad_times(timed)
    assert sorted((r.source_file, r.line_no) for r in good.collect()) == [("headless", 0), ("timed", 1), ("untimed", 1), ("untimed", 2)]
    assert [(r.source, r.key) for r in bad.collect()] == [("timed", "2")]
    long = {(r.source_file, r.column, r.value, r.timestamp_source) for r in lg.to_long(good).collect()}
    assert long == {("timed", "v", "1", "original"), ("untimed", "a", "x", "none"), ("untimed", "b", "y", "none"), ("untimed", "a", "z", "none"), ("untimed", "b", "w", "none")}


def test_flags_see_the_last_value(spark):
    from wellspark.operators import profile as pf

    rows = [("f", r, c, n, v) for r in range(40) for c, (n, v) in enumerate([("timestamp", f"2024-01-01 00:00:{r:02d}"), ("temp", "5 °C" if r == 39 else "5 C"), ("note", "# x" if r == 38 else "ok")])]
    flags = pf.profile_files(spark.createDataFrame(rows, "file string, row int, col int, name string, cell string")).first()
    assert flags.units_in_values and flags.comment_cells and not flags.is_standard and flags.n_rows == 40
