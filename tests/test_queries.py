"""Every registered query against its SQL twin (or for rows) on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, text = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    if text == "0 rows":  # both sides agree that this small scale holds no such row: the next one decides
        ok, text = compare(spark, connect(LARGER), name, QUERIES[name], ORACLES.get(name), LARGER)
    assert ok, text


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1
    assert df.columns == ["plate_id", "well_id", "raw data", "value_num", "raw mapping"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
