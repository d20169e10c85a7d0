"""Every registered query that has SQL gives the rows DuckDB gives on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare_oracle import connect, difference

SF = "/root/testdata/sf0.001"
# 150 customers are enough for every query
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF), duck.sql(SQL[name])) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 2
