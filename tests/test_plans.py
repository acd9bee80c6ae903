"""Shape of the physical plans: pruning, push-down, partial limits, no pair joins."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

QUERIES = entry.queries()
EAGER = ("str_", "src_07", "snk_01", "snk_02", "snk_04", "snk_10b", "cln_13")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["agg_04_top_users", "join_01b_from_raw_files", "log_09_match_annotation", "join_12_visible_counts", "prj_07_may_modify", "plt_07_scopes", "join_08_calendar"])
def test_no_pair_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["agg_04_top_users", "join_07_keep_newest", "win_02_newest_per_key", "flt_08_newest_of_organization", "win_04_first_values"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_time_filter_reaches_the_scan(spark):
    text = plan(spark, "agg_01_usage_summary")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text)


def test_scans_read_only_needed_columns(spark):
    text = plan(spark, "agg_23_record_count")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("o_totalprice" not in s and "c_name" not in s for s in schemas)


def test_top_k_needs_no_global_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "sort_03_top_k")


def test_window_keys_include_the_chunk(spark):
    for name in ("win_06_failed_logins", "log_06_event_sequence", "plt_05_plate_segments"):
        text = plan(spark, name)
        assert "__chunk" in text


def test_profile_reads_the_cells_twice_at_most(spark):
    text = plan(spark, "log_02_standard_structure")
    assert text.count("FileScan") <= 2 and text.count("Exchange hashpartitioning") <= 4
