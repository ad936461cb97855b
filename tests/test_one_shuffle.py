"""Notes of a sweep are dealt once, and a song without any line keeps its notes' ends."""

import os

import pytest

from cadenza.operators import dedupe as D, sweeps as P
from cadenza.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_deduped_notes_are_dealt_once(spark):
    plan = registry.QUERIES["deduped_notes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in x for x in plan.splitlines()) == 1 and "Join" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_any_partitioning_gives_the_same_notes(spark):
    def rows(partitions):
        s = spark.newSession()
        s.conf.set("spark.sql.shuffle.partitions", str(partitions))
        return sorted(map(str, registry.QUERIES["deduped_notes"](s, SF).collect()))

    assert rows(1) == rows(7) == rows(64)


def test_ends_without_a_line(spark):
    rows = [(1, i, 60, 200.0 * i, 200.0 * i + 50, 30.0 * i, 30.0 * i + 2, 3) for i in range(3)] + [(2, 0, 60, 0.0, 50.0, 1.0, 9.0, 3), (2, 1, 62, 10.0, 40.0, 3.0, 4.0, 3), (2, 2, 62, 300.0, None, 3.0, 4.0, 3)]
    d = spark.createDataFrame(rows, "k int, i int, p int, x0 double, x1 double, t_start double, t_end double, life int")
    d = D.dedupe_sweep(d.selectExpr("*", "0 AS sweep"), ["k"], "sweep", "i", "p")
    got = {(r.k, r.i): (r.action, r.other, r.t_start, r.t_end) for r in d.collect()}
    assert got == {(1, i): ("kept", None, 30.0 * i, 30.0 * i + 2) for i in range(3)} | {(2, 0): ("kept", None, 1.0, 9.0), (2, 1): ("ghost-coexist", 0, 3.0, 4.0), (2, 2): ("kept", None, 3.0, 4.0)}


def test_sweeps_carry_columns(spark):
    rows = [(1, i, float(x), x + 20.0, i * 0.5, i * 0.5 + 0.4, f"n{i}") for i, x in enumerate((0, 100, 200, 0, 100, 300, 0, 500))]
    d = spark.createDataFrame(rows, "k int, i int, x0 double, x1 double, t_start double, t_end double, name string")
    got = {r.i: r for r in P.confirmed_sweeps(d, ["k"], "i", carry=["x0", "name"]).collect()}
    want = {r.i: r.sweep for r in P.confirmed_sweeps(d, ["k"], "i").collect()}
    assert {i: r.sweep for i, r in got.items()} == want and all(r.name == f"n{i}" and r.x0 == rows[i][2] for i, r in got.items())
