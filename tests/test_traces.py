"""Folds over traces and bars against plain loops, and pitches of sound."""

import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions.audio import pitch, pitch_classes, pitch_of, semitone_energies
from cadenza.operators import intervals as I, scoring as C, sequence as S, sweeps as P


def test_traces_follow_their_heading(spark):
    rng = random.Random(5)
    rows = [(k, t * 0.1, float(x)) for k in range(4) for t in range(60) if rng.random() < 0.9 for x in {round(20 * t + rng.randint(-9, 9)), rng.randrange(1200)}]
    got = sorted((r.k, r.t, r.x) for r in P.smoothed_track(spark.createDataFrame(rows, "k int, t double, x double"), ["k"], "t", "x").collect())
    want = []
    for k in range(4):
        t0 = x0 = v = None
        for t in sorted({t for q, t, _ in rows if q == k}):
            xs = sorted(x for q, u, x in rows if q == k and u == t)
            pick = None
            if t0 is not None and t - t0 <= 0.4:
                aim = x0 + v * (t - t0)
                pick = next((x for x in sorted(xs, key=lambda x: abs(x - aim)) if abs(x - aim) <= 60), None)
            if pick is None:
                pick, v = xs[0], 200.0
            else:
                v = 0.7 * v + 0.3 * (pick - x0) / (t - t0)
            t0, x0 = t, pick
            want.append((k, t, pick))
    assert got == want


def test_sweeps_need_a_second_note(spark):
    n = [(0, 0.0, 10.0), (1, 1.0, 200.0), (2, 2.0, 30.0), (3, 3.0, 300.0), (4, 4.0, 20.0), (5, 5.0, 60.0), (6, 6.0, 400.0), (7, 7.0, 100.0)]
    d = spark.createDataFrame([(1, i, x, x + 20, t, t + 0.5) for i, t, x in n], "k int, i int, x0 double, x1 double, t_start double, t_end double")
    got = {r.i: r.sweep for r in P.confirmed_sweeps(d, ["k"], "i").collect()}
    # 2 is alone on the left and goes with the sweep of its time; 7 is the last one, nearest to the second sweep's beginning
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}


def test_segments_on_one_line_are_one_page(spark):
    line = lambda s, t0, t1, a: [(1, s, t / 10, a + 100.0 * t / 10) for t in range(t0, t1)]
    rows = line(0, 0, 10, 0) + line(1, 30, 45, 5) + line(2, 60, 75, -400) + [(1, 3, 9.0, 1.0), (1, 3, 9.9, 900.0)]
    got = sorted((r.page, r.n, round(r.rate), round(r.t0, 2), r.t_a, r.t_b) for r in P.swept_pages(spark.createDataFrame(rows, "k int, s int, t double, x double"), ["k"], "s", "t", "x").collect())
    assert got == [(0, 25, 100, 0.0, 0.0, 4.4), (1, 15, 100, 4.0, 6.0, 7.4)]


def test_clusters_and_tracks_like_plain_loops(spark):
    rng = random.Random(7)
    rows = [(k, i, float(rng.randrange(0, 60, 3)), float(100 + rng.randrange(0, 40, 4)), float(rng.choice([0, 2, 5])), 9.0) for k in range(3) for i in range(80)]
    d = spark.createDataFrame(rows, "k int, f int, x0 double, x1 double, cy double, h double")
    want, tracks = [], []
    for k in range(3):
        boxes, bars = [], []
        for _, f, x0, x1, cy, _ in (r for r in rows if r[0] == k):
            for b in boxes:
                if abs(b[2] - cy) < 4 and abs(b[0] - x0) <= 6 and abs(b[1] - x1) <= 8:
                    b[0], b[1], b[3] = min(b[0], x0), max(b[1], x1), b[3] + 1
                    break
            else:
                boxes.append([x0, x1, cy, 1])
            for t in bars:
                if f - t[1] <= 5 * 4 and f - t[1] <= 4 * 4 and t[6] and abs(t[4] - cy) <= 5 and abs(t[2] - x0) <= 7 and x1 >= t[3] - 8:
                    t[1:6] = [f, min(t[2], x0), max(t[3], x1), 0.7 * t[4] + 0.3 * cy, t[5] + 1]
                    break
            else:
                bars.append([f, f, x0, x1, cy, 1, True])
            for t in bars:
                t[6] = t[6] and f - t[1] <= 20
        want += [(k, *b) for b in boxes]
        tracks += [(k, *t[:4], round(t[4], 9), t[5]) for t in bars]
    assert sorted((r.k, r.x0, r.x1, r.cy, r.seen) for r in I.cluster_bars(d, ["k"], ["f"]).collect()) == sorted(want)
    assert sorted((r.k, r.first_f, r.last_f, r.x0, r.x1, round(r.cy, 9), r.hits) for r in I.grow_tracks(d, ["k"], "f", 4).collect()) == sorted(tracks)


def test_outliers_of_a_trace(spark):
    rng = random.Random(9)
    rows = [(1, i / 4, None if rng.random() < 0.1 else 30.0 * i + (300.0 if rng.random() < 0.15 else rng.random())) for i in range(60)] + [(2, 0.0, 5.0), (2, 0.5, 900.0)]
    got = {(r.k, r.t): r.cleaned for r in S.reject_outliers(spark.createDataFrame(rows, "k int, t double, x double"), ["k"], "t", "x", 2.0, 25.0).collect()}
    for k, t, x in rows:
        p = np.array([(u, v) for q, u, v in rows if q == k and v is not None and abs(u - t) <= 2.0])
        keep = x
        if x is not None and len(p) > 2:
            i, j = np.triu_indices(len(p), 1)
            s = np.median((p[j, 1] - p[i, 1]) / (p[j, 0] - p[i, 0]))
            keep = x if abs(x - s * t - np.median(p[:, 1] - s * p[:, 0])) <= 25 else None
        assert got[k, t] == keep, (k, t)


def test_shown_pitches_carry_on(spark):
    rows = [(1, 0.1, 50.0, None), (1, 0.2, 49.0, 73), (1, 0.3, 38.0, None), (1, 0.4, None, 60), (1, 0.5, 50.0, None), (2, 0.1, 50.0, 62)]
    got = sorted((r.session_id, r.t, r.shown) for r in C.shown_pitches(spark.createDataFrame(rows, "session_id int, t double, midi double, note_midi int")).collect())
    assert got == [(1, 0.1, 50.0), (1, 0.2, 73.0), (1, 0.3, 74.0), (1, 0.5, 74.0), (2, 0.1, 62.0)]


def test_finished_sessions(spark):
    notes = spark.createDataFrame([(7, 0, 0.0, 1.0), (7, 1, 1.0, 2.0)], "song_id int, pos int, t_start double, t_end double")
    results = spark.createDataFrame([(1, 7, 0, 0.0, 1.0, 0.9, 12.4, 0.9, 3, 1), (1, 7, 1, 1.0, 2.0, 0.0, None, 0.0, None, 1), (2, 7, 0, 0.0, 1.0, 0.0, None, 0.0, None, 0), (3, 7, 0, 0.0, 1.0, 0.5, None, 0.5, 1, 1)], "session_id int, song_id int, pos int, t_start double, t_end double, acc double, cents double, hit double, rating int, combo int")
    got = {r.session_id: r for r in C.finished(results, notes).collect()}
    assert set(got) == {1, 3} and got[1].completed and not got[3].completed
    assert got[1].results == '{"notes":[[3,0.9,12],[null,0,null]]}' and got[3].results == '{"notes":[[1,0.5,null],[null,0,null]]}' and got[1].score == round(100 * 0.9**0.7, 3)


def test_recent_and_apart(spark):
    bars = spark.createDataFrame([(1, 0, 0.0, 5.0, 1.0), (1, 1, 1.0, 6.0, 1.0), (1, 2, 50.0, 60.0, 1.0)], "k int, i int, x0 double, x1 double, cy double")
    assert sorted(r.i for r in P.unlike_recent(bars, ["k"], "i", "i", ("x0", "x1", "cy")).collect()) == [0, 2]
    n = spark.createDataFrame([(1, 1.0, 5), (1, 2.0, 5), (1, 9.0, 3), (2, 4.0, 1)], "k int, t double, n int")
    assert sorted((r.k, r["first"], r.second) for r in P.two_apart(n, ["k"], "t", "n", 3.0).collect()) == [(1, 1.0, 9.0), (2, 4.0, None)]


def test_pitch(spark):
    t = np.arange(2048) / 22050
    wave = 0.5 * np.sin(2 * np.pi * 220 * t) + 0.2 * np.sin(2 * np.pi * 440 * t)
    assert abs(pitch_of(wave, 22050) - 57) < 0.05 and pitch_of(wave * 1e-4, 22050) is None
    assert pitch_of(np.random.RandomState(0).normal(size=2048), 22050) is None
    d = spark.createDataFrame([(wave.tolist(),), (None,)], "x array<double>")
    got = [r.p for r in d.select(pitch(d.x, 22050.0).alias("p")).collect()]
    assert abs(got[0] - 57) < 0.05 and got[1] is None


def test_settled_states_like_a_plain_loop(spark):
    rng = random.Random(9)
    rows, want = [], []
    for key in range(4):
        state, taken, run, before = 0, None, 0, object()
        for i in range(300):
            state = state if rng.random() < 0.7 else rng.choice([None, state, (state or 0) ^ 1, rng.getrandbits(12), 0])
            rows.append((key, i, state))
            run = run + 1 if state == before else 1
            start = i if run == 1 else start
            before = state
            if run == 3 and state is not None and (taken is None or bin(taken ^ state).count("1") >= 3):
                taken = state
                want.append((key, state, start))
    d = spark.createDataFrame(rows, "key int, i int, cells long")
    assert sorted(tuple(r)[:3] for r in S.settled_states(d, ["key"], ["i"], "cells").collect()) == sorted(want)
    b = d.withColumn("cells", F.unhex(F.lpad(F.hex("cells"), 4, "0")))
    assert sorted((r.key, int.from_bytes(r.cells, "big"), r.first_i) for r in S.settled_states(b, ["key"], ["i"], "cells").collect()) == sorted(want)
    assert S.settled_states(d.limit(0), ["key"], ["i"], "cells").count() == 0


def test_energies_of_sound_files(spark, tmp_path):
    t = np.arange(22050 * 14) / 22050
    sound = {"a": np.sin(2 * np.pi * 440 * t), "c": np.sin(2 * np.pi * 261.6256 * t[:20000]), "short": t[:100]}
    (tmp_path / "sound").mkdir()
    for name, x in sound.items():
        (tmp_path / "sound" / f"{name}.f32").write_bytes(x.astype("<f4").tobytes() + b"\x00")
    d = semitone_energies(spark.read.format("binaryFile").load(f"{tmp_path}/sound"))
    rows = d.withColumn("classes", pitch_classes(F.col("energy"))).collect()
    frames = {n: sorted(r.frame for r in rows if r.path.endswith(f"/{n}.f32")) for n in sound}
    assert frames == {"a": list(range(1 + (len(t) - 8192) // 1024)), "c": list(range(1 + (20000 - 8192) // 1024)), "short": []} and len(frames["a"]) > 256
    for r in rows:
        a = r.path.endswith("/a.f32")
        assert len(r.energy) == 67 and 30 + int(np.argmax(r.energy)) == (69 if a else 60) and r.classes[0]["class"] == (9 if a else 0)
        assert abs(r.t - r.frame * 1024 / 22050) < 1e-9 and [c.energy for c in r.classes] == sorted((c.energy for c in r.classes), reverse=True)
    one = next(r for r in rows if r.path.endswith("/a.f32") and r.frame == 200)
    part = np.abs(np.fft.rfft(sound["a"][200 * 1024 :][:8192] * np.hanning(8192)))
    f = np.fft.rfftfreq(8192, 1 / 22050)
    for j in range(67):
        hz = 440 * 2 ** ((30 + j - 69) / 12)
        inside = part[(f >= hz * 0.971) & (f < hz * 1.03)]
        assert abs(one.energy[j] - (inside.max() if len(inside) else 0.0)) < 1e-2
