"""Robust lines come from all points of a group, whatever its size."""

import random

import duckdb
import numpy as np
import pytest

from cadenza.operators import robust as R
from cadenza.plans import registry
from tests_common import plain


def test_lines_of_songs_of_many_notes_equal_their_sql(spark, tmp_path):
    rng = random.Random(7)
    c = duckdb.connect()
    notes = [(k, rng.randrange(20_000), rng.randrange(1000), rng.randrange(1, 8), rng.randrange(1, 51)) for k, n in enumerate((61, 90, 300, 1300)) for _ in range(n)]
    c.execute("CREATE TABLE n (k BIGINT, p BIGINT, s BIGINT, l INT, q DOUBLE)")
    c.executemany("INSERT INTO n VALUES (?, ?, ?, ?, ?)", notes)
    c.execute(f"""COPY (SELECT k AS l_orderkey, p AS l_partkey, s AS l_suppkey, l AS l_linenumber, q AS l_quantity, q * 3 AS l_extendedprice, TIMESTAMP '2024-01-01' AS l_shipdate FROM n) TO '{tmp_path}/lineitem.parquet'""")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(c.execute(registry.ORACLES["sweep_lines"]).fetchall())
    got = sorted(map(tuple, registry.QUERIES["sweep_lines"](spark, str(tmp_path)).collect()))
    assert [plain(tuple(r)) for r in got] == [plain(r) for r in want] and [r[3] for r in got] == [61, 90, 300, 1300]


@pytest.mark.parametrize("seed", range(6))
def test_slopes_counted_by_digits_are_those_of_arrays(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 400))
    t = np.sort(rng.integers(1, 51, n) / 4 if seed % 2 else rng.uniform(-5, 5, n))
    x = rng.integers(-3, 4, n) * 1.0 if seed > 3 else rng.normal(0, 100, n)
    want = R.theil_sen_line(t, x)
    monkeypatch.setattr(R, "WHOLE", 1)
    monkeypatch.setattr(R, "BLOCK", 500)
    assert R.theil_sen_line(t, x) == want


def test_slopes_of_odd_points(monkeypatch):
    monkeypatch.setattr(R, "WHOLE", 1)
    line = lambda *p: R.theil_sen_line(*np.array(p, float).T)
    assert line((1, 2), (1, 3)) is None and line((1, 2), (1, 2), (2, 2)) == (0.0, 2.0) and line((0, 0), (1, 5), (2, -2), (2, -2)) == (-1.0, 0.0)
    assert np.isnan(line((0, 0), (1, np.nan))[0]) and line((0, 0), (1, np.inf))[0] == np.inf
