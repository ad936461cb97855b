"""Exact percentiles, bisection and anchoring against plain computations on random rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import anchoring as A, selection as X

AT = {"least": 0.0, "low": 0.013, "half": 0.5, "high": 0.97, "most": 1.0}


@pytest.mark.parametrize("large, accuracy", [(10, 50), (10, 10_000), (10**6, 100)])
def test_quantiles_of_hot_groups(spark, large, accuracy):
    rng = random.Random(2)
    groups = {"ties": [float(rng.choice([1, 2, 2, 2, 9])) for _ in range(700)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(900)], "some": [rng.gauss(0, 1) for _ in range(501)],
              "few": [3.0, 1.0, 4.0], "one": [7.5], None: [rng.random() for _ in range(44)], "equal": [5.0] * 90}
    rows = [(k, x, 1) for k, v in groups.items() for x in v] + [("some", None, 1), ("nothing", None, 1)]
    d = spark.createDataFrame(rows, "k string, x double, low int").repartition(5)
    got = {r.k: r for r in X.quantiles(d, ["k"], "x", AT, large, accuracy).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        for name, q in AT.items():
            assert got[k][name] == pytest.approx(float(np.quantile(v, q)), rel=1e-9), (k, name)
    (alone,) = X.quantiles(d.where("k = 'wide'"), [], "x", {"half": 0.5}, large, accuracy).collect()
    assert alone.half == pytest.approx(float(np.median(groups["wide"])))
    assert X.quantiles(d.limit(0), ["k"], "x", AT, large, accuracy).count() == 0


def test_bisection_equals_a_scan(spark):
    rng = random.Random(4)
    frames, requests = [], []
    for k in range(12):
        n, flip = rng.choice([1, 2, 7, 64, 300]), rng.randint(-3, 320)
        frames += [(k, i, i >= flip) for i in range(n)]
        requests += [(k, j, rng.randint(-2, 20), rng.randint(-2, n + 3)) for j in range(6)]
    requests += [requests[0], (None, 0, 0, 5), (99, 0, 0, 5), (1, 9, None, 5)]
    f = spark.createDataFrame(frames, "k int, at int, colour boolean")
    r = spark.createDataFrame(requests, "k int, id int, low int, high int")
    seen = f.sparkSession.sparkContext.accumulator(0)

    @F.udf("boolean")
    def looked(colour):
        seen.add(1)
        return colour

    got = X.bisected(r, f, ["k"], "at", "low", "high", looked(F.col("colour"))).collect()
    have = {(k, i): c for k, i, c in frames}

    def scan(k, low, high):
        if low is None or high <= low or not have.get((k, high)):
            return None
        return next(i for i in range(low + 1, high + 1) if have.get((k, i)))

    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, i, a, b, scan(k, a, b))) for k, i, a, b in requests)
    assert seen.value <= len(requests) * 11  # a frame for each open request and round, not every frame for each request
    assert X.bisected(r.limit(0), f, ["k"], "at", "low", "high", F.col("colour")).count() == 0


def test_anchoring_equals_a_loop(spark):
    rng = np.random.RandomState(5)
    size, low, step = 40, 45, 0.5
    frames = {s: np.abs(rng.randn(30 + 10 * s, size)) * rng.choice([0.1, 5], (30 + 10 * s, 1)) for s in (1, 2)}
    notes = [(s, i, float(rng.uniform(0, 15 + 5 * s)), int(rng.randint(-6, 7))) for s in (1, 2, 3) for i in range(25)]
    notes = [(s, i, t, t + float(rng.choice([0.05, 0.6, 2])), k) for s, i, t, k in notes]
    f = spark.createDataFrame([(s, i, [float(x) for x in row]) for s, v in frames.items() for i, row in enumerate(v)], "song long, frame long, energy array<double>").repartition(3)
    n = spark.createDataFrame(notes, "song long, pos int, t_start double, t_end double, k int").repartition(3)
    got = {r.song: r for r in A.anchored(f, n, "song", "pos", "k", step, low, size).collect()}
    assert got.keys() == {1, 2}
    for s, v in frames.items():
        logs = np.log1p(v)
        logs /= np.maximum(logs.mean(1, keepdims=True), 1e-6)
        own = [x for x in notes if x[0] == s]
        ks, scores = [x[4] for x in own], {}
        for base in range(low, low + size):
            if base + min(ks) < low or base + max(ks) >= low + size or not 53 <= base + np.median(ks) <= 76:
                continue
            total = count = 0
            for _, _, a, b, k in own:
                first = int((a + 0.15 * (b - a)) / step)
                last = max(first + 1, int((b - 0.15 * (b - a)) / step))
                if last > len(v):
                    break
                at = base + k - low
                total += logs[first:last, at].mean() + (0.35 * logs[first:last, at + 12].mean() if at + 12 < size else 0)
                count += 1
            scores[base] = total / count
        best, second = sorted(scores.items(), key=lambda x: -x[1])[:2]
        assert (got[s].base, got[s].score, got[s].margin) == (best[0], pytest.approx(best[1]), pytest.approx(best[1] - second[1]))
    assert A.anchored(f.limit(0), n, "song", "pos", "k", step, low, size).count() == 0


def test_notes_of_one_middle_meet_their_frames_once(spark):
    frames = spark.createDataFrame([(1, f, [1.0]) for f in range(4)], "song int, frame long, energy array<double>")
    notes = spark.createDataFrame([(1, p, 0.0, 2.0 + p % 2, 7) for p in range(1000)] + [(1, 1000, 3.0, 9.0, 7)], "song int, pos int, t_start double, t_end double, k int")
    got = {r.frame: r.weight for r in A.frame_weights(frames, notes, "song", "pos", "k", 1.0).collect()}
    assert {f: round(w, 6) for f, w in got.items()} == {0: 750.0, 1: 250.0}
