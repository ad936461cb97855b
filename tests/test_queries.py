"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import pytest

from cadenza.plans import registry
from tests_common import duckdb_of, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = rows_of(registry.QUERIES[name](spark, SF))
    assert got[1], "a query without rows says nothing"
    if name in registry.ORACLES:
        assert got == rows_of(duckdb_of(SF).execute(registry.ORACLES[name]))


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.ORACLES) <= set(registry.QUERIES)
