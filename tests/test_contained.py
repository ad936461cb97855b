"""Notes that none contains, with the columns of their SQL."""

import os

import pytest

from cadenza.plans import registry
from tests_common import duckdb_of, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_uncontained_notes_have_the_columns_of_their_sql(spark):
    d = registry.QUERIES["uncontained_notes"](spark, SF)
    sql = duckdb_of(SF).execute(registry.ORACLES["uncontained_notes"])
    assert d.columns == [c[0] for c in sql.description] and rows_of(d) == rows_of(sql)
