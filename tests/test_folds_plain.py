"""Folds that SQL can't say, against plain loops on random rows."""

import random
import statistics

import numpy as np
import pytest

from cadenza.functions.audio import pitch_of
from cadenza.operators import intervals as I, joins as J, robust as R, sweeps as P


def test_greedy_overlaps(spark):
    rng = random.Random(1)
    bars = [(k, i, a, a + rng.choice([5.0, 20.0, 40.0])) for k in (1, 2, None) for i in range(40) for a in [float(rng.randrange(0, 300))]]
    shots = [(k, i, a, a + rng.choice([5.0, 20.0, 40.0])) for k in (1, 2, 3) for i in range(30) for a in [float(rng.randrange(0, 300))]]
    l = spark.createDataFrame(bars, "k int, i int, a double, b double").repartition(3)
    r = spark.createDataFrame(shots, "k int, j int, c double, d double").repartition(3)
    got = J.greedy_overlap(l, r, ["k"], ("a", "b"), ("c", "d"), "i", "j").collect()
    want = {}
    for k in (1, 2):
        used = set()
        for _, i, a, b in sorted((x for x in bars if x[0] == k), key=lambda x: (x[2], x[1])):
            may = [(-(min(b, d) - max(a, c)), j) for q, j, c, d in shots if q == k and j not in used and min(b, d) - max(a, c) > 0]
            if may:
                _, j = min(may)
                used.add(j)
                want[k, i] = j
    assert {(x.k, x.i): x.j for x in got if x.j is not None} == want and len(want) > 20


def test_tracks_over_frames(spark):
    rng = random.Random(2)
    rows = [(k, f, x, x + rng.choice([10, 30, 60]), rng.choice([0.0, 6.0, 11.0, 30.0])) for k in (1, 2) for f in range(0, 120) if rng.random() < 0.7 for _ in range(rng.randint(1, 3)) for x in [rng.randrange(0, 120)]]
    d = spark.createDataFrame(rows, "k int, f int, x0 int, x1 int, cy double").repartition(3)
    got = sorted((r.k, r.first_f, r.last_f, r.x0, r.x1, round(r.cy, 6), r.hits) for r in I.track(d, ["k"], "f").collect())
    want = []
    for k in (1, 2):
        tracks = []
        for _, f, x0, x1, cy in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[4], r[2])):
            best = None
            for t in tracks:
                both = min(t[3], x1) - max(t[2], x0)
                if f - t[1] <= 20 and not t[6] and abs(t[4] - cy) < 12 and both > 0.5 * min(t[3] - t[2], x1 - x0) and (best is None or both > best[0]):
                    best = (both, t)
            for t in tracks:
                t[6] = t[6] or f - t[1] > 20
            if best:
                t = best[1]
                t[1], t[3], t[4], t[5] = f, max(t[3], x1), 0.7 * t[4] + 0.3 * cy, t[5] + 1
            else:
                tracks.append([f, f, x0, x1, cy, 1, False])
        want += [(k, *t[:4], round(t[4], 6), t[5]) for t in tracks]
    assert got == sorted(want) and len({r[6] for r in got}) > 3


def test_pages_of_segments(spark):
    rng = random.Random(3)
    rows = []
    for k in (1, 2):
        for s in range(14):
            t, x, rate = s * 2 + rng.random(), rng.choice([0.0, 50.0, 400.0]), rng.choice([100.0, 300.0, 20.0])
            rows += [(k, s, t + i * 0.1, x + rate * i * 0.1 + rng.gauss(0, rng.choice([0.5, 30]))) for i in range(rng.choice([1, 5, 9, 14]))]
        rows += [(k, 20 + s, 100 + s * 2 + i * 0.1, 100.0 * (s * 2 + i * 0.1) + rng.gauss(0, 0.5)) for s in range(3) for i in range(12)]
    d = spark.createDataFrame(rows, "k int, s int, t double, x double").repartition(3)
    got = sorted((r.k, r.page, r.t_a, r.t_b, round(r.rate, 6), round(r.t0, 6), r.n) for r in P.swept_pages(d, ["k"], "s", "t", "x").collect())
    want = []
    for k in (1, 2):
        fits = []
        for s in sorted({r[1] for r in rows if r[0] == k}):
            p = sorted(r[2:] for r in rows if r[:2] == (k, s))
            if len(p) < 8 or p[-1][0] - p[0][0] < 0.4:
                continue
            rate = statistics.median((b[1] - a[1]) / (b[0] - a[0]) for j, b in enumerate(p) for a in p[:j])
            if not 60 < rate < 1200:
                continue
            t0 = statistics.median(t - x / rate for t, x in p)
            if statistics.median(abs(x - (t - t0) * rate) for t, x in p) <= 8:
                fits.append([p[0][0], p[-1][0], rate, t0, len(p), p[0][1], p[-1][1]])
        pages = []
        for f in sorted(fits):
            last = pages[-1] if pages else None
            if last and abs((f[0] - last[3]) * last[2] - f[5]) <= 20 and f[0] - last[1] < 8 and f[5] > last[6]:
                last[1], last[4], last[6] = f[1], last[4] + f[4], f[6]
            else:
                pages.append(f)
        want += [(k, i, f[0], f[1], round(f[2], 6), round(f[3], 6), f[4]) for i, f in enumerate(pages)]
    assert got == want and any(r[6] > 30 for r in got)


def test_lines_through_most_points(spark):
    rng = random.Random(4)
    rows = []
    for k in range(5):
        rows += [(k, 1 + x / 200 + rng.gauss(0, 0.01), float(x)) for x in rng.sample(range(0, 900), 11)] + [(k, 7 + x / 150 + rng.gauss(0, 0.01), float(x)) for x in rng.sample(range(0, 900), 7)]
        rows += [(k, rng.uniform(0, 15), rng.uniform(0, 900)) for _ in range(8)]
    d = spark.createDataFrame([*rows, (9, 1.0, 2.0), (9, None, 2.0)], "k int, t double, x double").repartition(3)
    got = sorted((r.k, r.line, round(r.rate, 4), round(r.t0, 4), r.inliers) for r in R.ransac_lines(d, ["k"], "t", "x").collect())
    want = []
    for k in range(5):
        left = sorted(r[1:] for r in rows if r[0] == k)
        for line in range(2):
            best = None
            for i, (t, x) in enumerate(left):
                for u, y in left[i + 1 :]:
                    if u > t and abs(y - x) >= 100 and 60 < (y - x) / (u - t) < 1200:
                        rate = (y - x) / (u - t)
                        own = [q for q in left if abs(q[0] - (t - x / rate) - q[1] / rate) < 0.08]
                        if best is None or len(own) > len(best[0]):
                            best = own, rate
            if best is None or len(best[0]) < 4:
                break
            own = best[0]
            rate = statistics.median((b[1] - a[1]) / (b[0] - a[0]) for j, b in enumerate(own) for a in own[:j])
            rate = rate if 60 < rate < 1200 else best[1]
            want.append((k, line, round(rate, 4), round(statistics.median(t - x / rate for t, x in own), 4), len(own)))
            left = [q for q in left if q not in own]
    assert got == sorted(want) and {r[4] for r in got} & {10, 11, 12, 13}


@pytest.mark.parametrize("seed", range(4))
def test_pitch_by_all_lags(seed):
    """The normalised square difference by its definition, lag by lag."""
    rng = np.random.RandomState(seed)
    rate, n = 8000.0, 400
    t = np.arange(n) / rate
    for hz in (90.0, 130.8, 220.0, 441.0, 700.0, 2000.0, None):
        x = rng.randn(n) * 0.3 if hz is None else np.sin(2 * np.pi * hz * t + rng.rand()) * 0.5 + 0.2 * np.sin(4 * np.pi * hz * t) + rng.randn(n) * 0.02
        d = {lag: 2 * float((x[: n - lag] * x[lag:]).sum()) / float((x[: n - lag] ** 2).sum() + (x[lag:] ** 2).sum()) for lag in range(1, n - 1)}
        low, high = int(rate / 800), int(np.ceil(rate / 75))
        best = max(d[k] for k in range(low, high + 1))
        peaks = [k for k in range(low, high + 1) if d[k] > max(0.8 * best, 0.5) and d[k] >= d[k - 1] and d[k] > d[k + 1]]
        got = pitch_of(x, rate)
        if best < 0.55 or not peaks:
            assert got is None
            continue
        a, b, c = (d[peaks[0] + k] for k in (-1, 0, 1))
        f = rate / (peaks[0] + 0.5 * (a - c) / (a - 2 * b + c))
        assert got == (pytest.approx(69 + 12 * np.log2(f / 440), abs=1e-6) if 60 <= f <= 900 else None)
        if hz and hz < 720:
            assert abs(got - (69 + 12 * np.log2(hz / 440))) < 0.3
