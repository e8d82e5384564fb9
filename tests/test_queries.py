"""Every registered query against DuckDB on the smallest sample tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from grid_checks.compare import difference, duckdb_views
from grid_checks.duckdb_queries import ORACLE
from grid_checks.spark_queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def connection():
    return duckdb_views(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    result = contract.entry(spark)
    assert "fail_rate" in {r["metric_name"] for r in result.collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert difference(spark, connection, SF, name) is None
