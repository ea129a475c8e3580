"""Every query against its SQL, at the smallest scale."""

import __spark_entry__ as entry
import pytest
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, sf_dir)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "text", "redaction_count", "redacted_types"]
    assert df.count() > 0
