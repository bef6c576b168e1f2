"""Every registered query against its DuckDB text at the smallest scale factor."""

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_are_consistent():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ok, message = compare(df, con, ORACLES[name])
        assert ok, message
    else:
        assert df.count() > 0
