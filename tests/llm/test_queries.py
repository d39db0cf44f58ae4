"""The registered queries against SQL, and the rows of those that SQL can't express."""

import pytest
from compare import connect, difference

from tracewright.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op3_language", "op6_unigram", "op8_virtual_slots"])
def test_a_row_for_each_document(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES[name](spark, sf)
    assert got.count() == docs.count() and got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
