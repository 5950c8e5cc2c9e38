"""Every query with SQL against DuckDB on the smallest tables."""

import pytest
from check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# too few rows at this size to return anything; not empty at the next size
EMPTY_HERE = {"frequent_classes", "detect_t_shift_10_3"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names_match():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(SQL) - EMPTY_HERE))
def test_query(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], SQL[name], SF) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 12 and "coverage" in df.columns
