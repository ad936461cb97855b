"""Intervals that stream in the order of their starts, and those that points look through, against plain loops."""

import random

from cadenza.operators import intervals as I, joins as J


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def owned(rows, sliver, least):
    """What last_wins says, from all bounds and all intervals."""
    rows = [r for r in rows if None not in r and r[3] > r[2]]
    cuts, out = sorted({x for r in rows for x in r[2:]}), []
    for s, e in zip(cuts, cuts[1:]):
        if e - s >= sliver - 1e-9:
            on = min(((-a, b, i) for _, i, a, b in rows if a <= s and b >= e), default=None)
            if on and out and out[-1][0] == on[2] and s - out[-1][2] <= least + 1e-6:
                out[-1] = (on[2], out[-1][1], e)
            elif on:
                out.append((on[2], s, e))
    return [x for x in out if x[2] - x[1] >= least]


def test_last_wins_streams(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), i, a := rng.randrange(300) / 100, rng.choice([None, a, a + rng.randrange(1, 80) / 100])) for i in range(150)]
    d = I.last_wins(spark.createDataFrame(rows, "song int, pos int, t_start double, t_end double").repartition(3), ["song"], "pos")
    got = sorted(tuple(r) for r in d.collect())
    assert got == sorted((k, *x) for k in (1, 2) for x in owned([r for r in rows if r[0] == k], I.SLIVER, I.SHORTEST))
    assert "Join" not in plan(d) and "Window" not in plan(d)


def test_points_look_through_their_cell(spark):
    rng = random.Random(6)
    spans = [(rng.choice(["a", "b"]), i, a := rng.randrange(400) / 8, a + rng.randrange(-2, 33) / 8, None if rng.random() < 0.1 else f"n{i % 7}") for i in range(300)]
    points = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(500) / 8]), p) for p in range(500)]
    args = spark.createDataFrame(points, "k string, t double, p int"), spark.createDataFrame(spans, "k string, i int, a double, b double, name string"), ["k"], "t", ("a", "b"), ["i", "name"], 4.0
    for ident in (None, ["k", "t", "p"]):
        d = J.stab(*args, ident)
        got = {r.p: (r.i, r.name) for r in d.collect()}
        assert got == {p: max(((a, i, n) for q, i, a, b, n in spans if q == k and t is not None and a <= t <= b), default=(None, None, None))[1:] for k, t, p in points}
        assert plan(d).count("Join") == 1 and plan(d).count("Aggregate") == 1


def test_events_within_spans_without_pairs(spark):
    rng = random.Random(7)
    at = lambda: rng.choice([None, *[rng.randrange(200) / 4 for _ in range(9)]])
    spans = [(rng.choice([1, 2, None]), i, at(), at()) for i in range(120)]
    events = [(rng.choice([1, 2, 3, None]), at()) for _ in range(150)]
    d = J.events_within(spark.createDataFrame(spans, "k int, i int, lo double, hi double"), spark.createDataFrame(events, "k int, e double"), ["k"], ["i"], ("lo", "hi"), "e")
    inside = {(k, i): [e for q, e in events if None not in (k, q, e, lo, hi) and q == k and lo < e <= hi] for k, i, lo, hi in spans}
    assert {(r.k, r.i): (r.first_event, r.last_event, r.n) for r in d.collect()} == {x: (min(e), max(e), len(e)) for x, e in inside.items() if e}
    assert "Join" not in plan(d)
