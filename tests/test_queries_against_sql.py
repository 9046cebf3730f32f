"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
ORACLES = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    message, _ = compare(name, QUERIES[name](spark, SF), ORACLES[name], con)
    assert message is None or message == "close only"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 25


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
