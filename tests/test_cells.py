"""Interval joins with intervals of any length, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import joins as J

INF = float("inf")


def intervals(seed, n, long):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(-400, 400) / 4
        b = a + rng.choice([-1.0, 0.0, 0.25, 1.0, 3.0] + ([40.0, 500.0, 1e6, 1e9, INF] if long else []))
        out.append((rng.choice([1, 1, 2, None]), i, None if rng.random() < 0.05 else a, None if rng.random() < 0.05 else b))
    return out + ([(1, n, -INF, INF)] if long else [])


@pytest.mark.parametrize("long", [False, True])
def test_pairs_of_any_length(spark, long):
    left, right = intervals(1, 90, long), intervals(2, 80, long)
    l = spark.createDataFrame(left, "k int, i int, a double, b double").repartition(3)
    r = spark.createDataFrame(right, "k int, j int, c double, d double").repartition(3)
    want = sorted((x[1], y[1]) for x in left for y in right if None not in (*x, *y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    args = (l, r, ["k"], ("a", "b"), ("c", "d"), 2.0)
    assert sorted((x.i, x.j) for x in J.interval_pairs(*args).collect()) == want
    hit = {i for i, _ in want}
    for ident in (["i"], None):
        assert sorted(x.i for x in J.interval_pairs(*args, how="left_semi", ident=ident).collect()) == sorted(hit)
        assert sorted(x.i for x in J.interval_pairs(*args, how="left_anti", ident=ident).collect()) == sorted({x[1] for x in left} - hit)


@pytest.mark.parametrize("long, ident", [(False, None), (True, None), (True, ["k", "p"])])
def test_points_in_intervals_of_any_length(spark, long, ident):
    rng = random.Random(3)
    right = intervals(4, 80, long)
    points = [(rng.choice([1, 2, None]), p, rng.choice([None, rng.randrange(-500, 500) / 8])) for p in range(200)]
    d = spark.createDataFrame(points, "k int, p int, t double")
    got = {x.p: x.j for x in J.stab(d, spark.createDataFrame(right, "k int, j int, c double, d double"), ["k"], "t", ("c", "d"), ["j"], 2.0, ident).collect()}
    for k, p, t in points:
        held = [(c, j) for q, j, c, e in right if None not in (k, t, q, c, e) and q == k and c <= t <= e]
        assert got[p] == (max(held)[1] if held else None)
    assert len(got) == len(points)


def test_a_long_interval_is_two_rows_not_a_million(spark):
    r = spark.createDataFrame([(1, 0, 0.0, 4e6)], "k int, j int, c double, d double")
    cells = J.Cells([(r, "c", "d")], 4.0)
    assert r.select(F.size(cells.touched("c", "d", cells.level("c", "d"))).alias("n")).first().n <= 2
    assert r.select(F.size(cells.upwards("c", "d")).alias("n")).first().n <= 4
