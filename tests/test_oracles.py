"""Every query against its SQL in DuckDB, exactly."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import connect, difference  # noqa: E402

from tracewright.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf, con, name):
    assert difference(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_comparison_sees_differences(spark, con):
    assert difference(spark.sql("SELECT 1L AS a"), con, "SELECT 2 AS a") is not None
    assert difference(spark.sql("SELECT 1L AS a"), con, "SELECT 1 AS b") is not None


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
