"""Profiles, templates and folds by grids against plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import intervals as I, profiles as P, templates as T
from cadenza.sources import ingest


def peaks(q, height, quiet):
    out, i = [], 0
    while i < len(q):
        if q[i] is None or q[i] < height:
            i += 1
            continue
        a = i
        while i < len(q) and q[i] is not None and q[i] >= height:
            i += 1
        b = i - 1
        if b - a + 1 <= 14 and a >= 3 and (q[max(0, a - 8)] or 0) <= quiet and (q[min(len(q) - 1, b + 8)] or 0) <= quiet:
            out.append(((a + b) // 2, b - a + 1))
    return out


def test_peaks_and_bars_equal_loops(spark):
    rng = random.Random(1)
    data = [(i, [rng.choice([None, 0.0, 0.1, 0.5, 0.9, 0.9]) if rng.random() < 0.4 else 0.0 for _ in range(rng.randint(0, 60))]) for i in range(120)] + [(900, None), (901, [0.0] * 5 + [1.0] * 20 + [0.0] * 9)]
    d = spark.createDataFrame(data, "i int, q array<double>")
    got = {r.i: [tuple(x) for x in r.p or []] for r in d.select("i", P.isolated_peaks(F.col("q"), 0.8, 0.4).alias("p")).collect()}
    assert got == {i: peaks(q or [], 0.8, 0.4) for i, q in data} and any(got.values())
    masks = [(i, [[rng.choice([0, 0, 1]) for _ in range(12)] for _ in range(9)]) for i in range(40)] + [(99, []), (98, None), (97, [[0, 0, 0], [0, 0, 0]])]
    m = spark.createDataFrame(masks, "i int, m array<array<int>>").select("i", P.column_middles(F.col("m")).alias("c"))
    middles = {r.i: list(r.c or []) for r in m.collect()}
    for i, x in masks:
        want = [None if not any(r[k] for r in x) else sum(y for y, r in enumerate(x) if r[k]) / sum(r[k] for r in x) for k in range(len(x[0]))] if x else []
        assert middles[i] == pytest.approx(want)
    got = {r.i: [tuple(x) for x in r.b or []] for r in m.select("i", P.split_bars(F.col("c"), 2.0).alias("b")).collect()}
    for i, c in middles.items():
        parts, own = [], []
        for k, x in enumerate([*c, None]):
            if own and (x is None or abs(x - c[k - 1]) > 2.0):
                parts.append(own)
                own = []
            if x is not None:
                own.append(k)
        assert got[i] == [(p[0], p[-1] + 1, pytest.approx(sum(c[k] for k in p) / len(p))) for p in parts if len(p) >= 3]
    assert any(got.values())


@pytest.mark.parametrize("held", [4_000_000, 30])
def test_templates_equal_brute_force(spark, held):
    rng = np.random.RandomState(2)
    templates = [("a", rng.randn(5)), ("a", rng.randn(9)), ("b", rng.randn(5)), ("c", np.ones(4)), ("d", rng.randn(40))]
    signals = [rng.randn(rng.choice([5, 12, 12, 30])) for _ in range(40)] + [np.zeros(12), np.concatenate([np.zeros(3), 2 * templates[2][1] + 7, np.zeros(3)]), rng.randn(3)]
    t = spark.createDataFrame([(k, v.tolist()) for k, v in templates] + [(None, [1.0, 2.0]), ("e", []), ("f", [None, 1.0])], "label string, values array<double>")
    rows = [(i, s.tolist(), "x", 0) for i, s in enumerate(signals)] + [(100, None, "x", 0), (101, [], "x", 0), (102, [1.0, None, 3.0, 1.0, 5.0, 2.0], "x", 0)]
    d = spark.createDataFrame(rows, "i int, s array<double>, label_ string, at_ int").repartition(3)
    got = {r.i: r for r in T.matched(d, "s", t, held=held).collect()}
    norm = lambda x: (x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).sum()) if np.ptp(x) else 0 * x
    for i, s in enumerate(signals):
        found = {}
        for label, v in templates:
            for at in range(len(s) - len(v) + 1):
                found.setdefault(label, []).append((-float(norm(s[at : at + len(v)]) @ norm(v)), at))
        best = sorted((min(x)[0], k, min(x)[1]) for k, x in found.items())
        if not best:
            assert got[i].label is None and got[i].score is None
            continue
        assert got[i].score == pytest.approx(-best[0][0], abs=1e-9)
        if len(best) > 1 and best[1][0] - best[0][0] > 1e-9:
            assert (got[i].label, got[i].at, got[i].margin) == (best[0][1], best[0][2], pytest.approx(best[1][0] - best[0][0], abs=1e-9))
    assert got[41].label == "b" and got[41].at == 3 and got[41].score == pytest.approx(1)
    assert all(got[i].label is None for i in (100, 101, 102))
    assert {r.label for r in T.matched(d, "s", t, least=2.0, held=held).collect()} == {None}
    assert {r.label for r in T.matched(d, "s", t.limit(0), held=held).collect()} == {None}
    v = spark.createDataFrame([(1, 4, 0.5), (1, 3, 0.2), (1, 3, 0.4), (1, None, 9.0), (1, 2, None), (2, 7, 1.0)], "k int, c int, w double")
    assert sorted((r.k, r.choice, round(r.votes, 6), r.margin and round(r.margin, 6)) for r in T.voted(v, ["k"], F.col("c"), F.col("w")).collect()) == [(1, 3, 0.6, 0.1), (2, 7, 1.0, None)]


def test_preferred_spans_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([1, 2, 3]), a, a + rng.choice([0.0, 1.0, 5.0, 40.0, 900.0])) for k in (1, 2) for i in range(300) for a in [rng.randrange(0, 4000) / 4]]
    d = spark.createDataFrame([*rows, (3, 1, 1, None, 2.0), (3, 2, 1, 1.0, None)], "k int, i int, p int, a double, b double").repartition(4)
    got = sorted((r.k, r.i) for r in I.suppress_overlaps(d, ["k"], "i", [("p", True)], "a", "b").collect())
    want = []
    for k in (1, 2):
        taken = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])):
            if all(min(r[4], t[4]) - max(r[3], t[3]) <= 0.3 * min(r[4] - r[3], t[4] - t[3]) for t in taken):
                taken.append(r)
        want += [(k, r[1]) for r in taken]
    assert got == sorted(want) and len(want) < 500


def test_folds_of_one_large_page_are_linear(spark):
    def took(n, f):
        d = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(50 * n)) / 10).alias("x0"), (F.pmod(F.hash("id"), F.lit(40)) * 10.0).alias("cy")).withColumn("x1", F.col("x0") + 3)
        began = time.perf_counter()
        rows = f(d).count()
        return rows, time.perf_counter() - began

    for f in (lambda d: I.cluster_bars(d, ["k"], ["i"]), lambda d: I.suppress_overlaps(d, ["k"], "i", [("cy", True)], "x0", "x1")):
        took(1000, f)
        (_, small), (rows, large) = took(20_000, f), took(200_000, f)
        assert large < 25 * small + 5 and rows > 20_000  # all against all kept would be a hundred times as long


def test_thin_bars_follow_the_skin(spark):
    rows = [("low", 0, 20, h) for h in (10.0, 12.0, 14.0)] + [("low", 0, 3, 90.0)] + [("high", 0, 20, h) for h in (30.0, 20.0)] + [("none", 0, 2, 50.0), (None, 0, 9, 40.0)]
    d = ingest.with_thin(spark.createDataFrame(rows, "skin string, x0 int, x1 int, h double"), ["skin"])
    assert {r.skin: r.thin for r in d.collect()} == {"low": 8.0, "high": 15.0, "none": pytest.approx(10.8), None: 24.0} and d.count() == len(rows)
