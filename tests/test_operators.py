"""Small cases of the operators: ties, gaps, boundaries and order."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import scalars as X
from cadenza.operators import intervals as I, joins as J, relational as R, robust as B, sequence as S
from cadenza.sources import documents, ingest


def test_streaks(spark):
    day = dt.date(2024, 1, 20)
    rows = [(1, day - dt.timedelta(days=d)) for d in (9, 8, 7, 2, 1, 1)] + [(2, day - dt.timedelta(days=5))]
    d = S.day_streaks(spark.createDataFrame(rows, "u int, d date"), ["u"], "d")
    got = {r.u: (r.streak, r.longest) for r in S.current_and_longest(d, ["u"], F.lit(day)).collect()}
    assert got == {1: (2, 3), 2: (0, 1)}


def test_local_days(spark):
    d = spark.createDataFrame([("2024-01-01 14:59:00",), ("2024-01-01 15:00:00",)], "t string").select(S.local_day(F.col("t").cast("timestamp"), -540).alias("d"))
    assert [str(r.d) for r in d.collect()] == ["2024-01-01", "2024-01-02"]


def test_last_wins(spark):
    rows = [("s", 0, 0.0, 1.0), ("s", 1, 0.2, 0.5), ("s", 2, 0.9, 1.4), ("s", 3, 0.25, 0.4)]
    d = spark.createDataFrame(rows, "song string, pos int, t_start double, t_end double")
    got = sorted((round(r.t_start, 6), round(r.t_end, 6), r.pos) for r in I.last_wins(d, ["song"], "pos").collect())
    assert got == [(0.0, 0.2, 0), (0.2, 0.25, 1), (0.25, 0.4, 3), (0.4, 0.5, 1), (0.5, 0.9, 0), (0.9, 1.4, 2)]
    rows = [("s", 0, 0.0, 1.0), ("s", 1, 0.5, 0.51), ("s", 2, 2.0, 3.0), ("s", 3, 2.0, 3.0)]
    d = spark.createDataFrame(rows, "song string, pos int, t_start double, t_end double")
    kept = I.last_wins(d, ["song"], "pos")
    assert sorted((r.pos, r.t_start, r.t_end) for r in kept.collect()) == [(0, 0.0, 1.0), (2, 2.0, 3.0)]  # of equal intervals the first
    assert sorted(r.pos for r in I.shadowed(d, ["song"], "pos", kept).collect()) == [1, 3]


def test_last_wins_is_monophonic_and_idempotent(spark):
    rng = random.Random(1)
    rows = [(s, p, float(a), a + rng.randint(1, 9) / 2) for s in range(5) for p, a in enumerate(rng.sample(range(40), 20))]
    d = I.last_wins(spark.createDataFrame(rows, "song int, pos int, t_start double, t_end double"), ["song"], "pos").cache()
    by = {}
    for r in sorted(d.collect(), key=lambda r: (r.song, r.t_start)):
        assert r.t_start >= by.get(r.song, 0.0) - 1e-9
        by[r.song] = r.t_end
    again = I.last_wins(d.withColumn("pos", F.monotonically_increasing_id()), ["song"], "pos")
    assert sorted((r.song, r.t_start, r.t_end) for r in again.collect()) == sorted((r.song, r.t_start, r.t_end) for r in d.collect())


def test_asof_before_the_first_and_by_spans(spark):
    pages = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 11), ("a", 5.0, 12), ("b", 2.0, 20)], "k string, vis double, page int")
    at = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 4.9), ("a", 5.0), ("a", 900.0), ("b", 1.0), ("c", 9.0)], "k string, t double")
    for span in (None, 2.0):
        got = {(r.k, r.t): r.page for r in J.asof(at, pages, ["k"], "t", "vis", ["page"], span).collect()}
        assert got == {("a", 0.5): None, ("a", 1.0): 10, ("a", 4.9): 10, ("a", 5.0): 12, ("a", 900.0): 12, ("b", 1.0): None, ("c", 9.0): None}
    ahead = {(r.k, r.t): r.page for r in J.asof(at, pages, ["k"], "t", "vis", ["page"], forward=True).collect()}
    assert ahead["a", 0.5] == 10 and ahead["a", 4.9] == 11 and ahead["a", 900.0] is None and ahead["b", 1.0] == 20


def test_interval_pairs_like_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.randint(0, 3), i, float(a := rng.randint(-50, 50)), a + rng.choice([0, 1, 7, 60]) * 1.0) for i in range(n)]
    a, b = make(60), make(60)
    l, r = spark.createDataFrame(a, "k int, i int, a0 double, a1 double"), spark.createDataFrame(b, "k int, j int, b0 double, b1 double")
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((p.i, p.j) for p in J.interval_pairs(l, r, ["k"], ("a0", "a1"), ("b0", "b1"), 8.0).collect()) == want
    has = {i for i, _ in want}
    assert {p.i for p in J.interval_pairs(l, r, ["k"], ("a0", "a1"), ("b0", "b1"), 8.0, "left_anti").collect()} == set(range(60)) - has


def test_greedy_match_uses_each_once(spark):
    l = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 1.0, 11.0), (1, 2, 50.0, 51.0)], "k int, i int, a0 double, a1 double")
    r = spark.createDataFrame([(1, 7, 0.0, 10.0), (1, 8, 6.0, 12.0)], "k int, j int, b0 double, b1 double")
    assert sorted((x.i, x.j, x.overlap) for x in J.greedy_overlap(l, r, ["k"], ("a0", "a1"), ("b0", "b1"), "i", "j").collect()) == [(0, 7, 10.0), (1, 8, 5.0)]


def test_anchored_sessions(spark):
    d = spark.createDataFrame([(1, f) for f in (10, 11, 13, 40, 41)], "s int, f long")
    assert [(r.f, r.n) for r in S.anchored_sessions(d, ["s"], "f", 3, least=3).collect()] == [(13, 3)]
    d = spark.createDataFrame([(1, f) for f in (10, 12, 14, 14)], "s int, f long")
    assert [(r.f, r.n) for r in S.anchored_sessions(d, ["s"], "f", 3, least=3).collect()] == [(14, 3)]  # the window moves on


def test_circular_mode(spark):
    d = spark.createDataFrame([(1, h) for h in (178, 179, 0, 1, 90, 90, 90)], "s int, h int")
    r = B.circular_mode(d, ["s"], "h").first()
    assert r.weight == 4 and r.mode in (175, 176, 177, 178, 179, 0, 1, 2, 3, 4, 172, 173, 174)


def test_robust_lines(spark):
    rng = random.Random(3)
    rows = [(1, float(i), 5.0 * i + 2) for i in range(20)] + [(1, float(rng.randint(0, 20)), float(rng.randint(200, 400))) for _ in range(6)]
    d = spark.createDataFrame(rows, "k int, t double, x double")
    r = B.theil_sen(d, ["k"], "t", "x").first()
    assert abs(r.slope - 5) < 0.6
    best = B.ransac_lines(d, ["k"], "t", "x", 0.2, (1.0, 50.0), 10.0, most=1).first()
    assert (round(best.rate, 6), round(best.t0, 6), best.inliers) == (5.0, -0.4, 20)
    assert B.ransac_lines(d, ["k"], "t", "x", 0.2, (60.0, 1200.0), 100.0, most=1).where("inliers > 5").count() == 0  # too slow a line
    same = B.theil_sen_pairs(d.where("x < 150"), ["k"], "t", "x").first()
    assert (same.slope, same.intercept) == (5.0, 2.0)


def test_lattice(spark):
    d = spark.createDataFrame([(1, 3.0 + 9.5 * i) for i in range(12)], "k int, y double")
    r = B.lattice_fit(d, ["k"], "y").first()
    assert abs(r.spacing - 9.5) < 0.03 and np.isclose(r.phase, 3.0, atol=0.5)


def test_credit_and_ratings(spark):
    d = spark.createDataFrame([(0.75, 0.82), (1.175, 0.55), (1.6, 0.28), (9.0, 0.1)], "d double, a double")
    got = d.select(F.round(X.credit(F.col("d")), 6).alias("c"), X.rating(F.col("a")).alias("r")).collect()
    assert [(r.c, r.r) for r in got] == [(1.0, 3), (0.5, 2), (0.0, 1), (0.0, 0)]
    s = spark.createDataFrame([(0.2, 0.4), (1.0, 1.0)], "h double, d double").select(X.total_score(F.col("h"), F.col("d")).alias("s")).collect()
    assert [r.s for r in s] == [None, 100.0]


def test_titles_and_addresses(spark):
    t = "【カラオケ練習用】みどりの丘／山田うた｜[Videoke] Green Hill - Uta Yamada - カラオケ@DIVA"
    r = spark.createDataFrame([(t,), ("x",)], "t string").select(X.title_parts(F.col("t")).alias("p")).collect()
    assert tuple(r[0].p) == ("みどりの丘", "山田うた", "[Videoke] Green Hill - Uta Yamada - カラオケ@DIVA", "Green Hill", "Uta Yamada") and set(r[1].p) == {None}
    v = "dQw4w9WgXcQ"
    urls = [v, f"https://www.youtube.com/watch?v={v}&t=1", f"youtu.be/{v}?si=1", f"https://youtube.com/shorts/{v}", f"https://evil.com/watch?v={v}", "", None, f"https://www.youtube-nocookie.com/embed/{v}", "https://youtu.be/short"]
    got = [r.v for r in spark.createDataFrame([(u,) for u in urls], "u string").select(X.video_id(F.col("u")).alias("v")).collect()]
    assert got == [v, v, v, v, None, None, None, v, None]


def test_ruby(spark):
    d = spark.createDataFrame([("残酷《ざんこく》な天使《てんし》の｜テーゼ《these》",)], "t string").select(X.ruby(F.col("t")).alias("r"), X.plain(F.col("t")).alias("p"), X.annotate(F.col("t"), {"天使": "てんし", "天": "てん"}).alias("a")).first()
    assert [(x.base, x.reading) for x in d.r] == [("残酷", "ざんこく"), ("天使", "てんし"), ("テーゼ", "these")] and d.p == "残酷な天使のテーゼ" and [(x.base, x.reading) for x in d.a] == [("天使", "てんし")]


def test_other_scalars(spark):
    d = spark.createDataFrame([(60, "a.b_c@x.org", "/x/y.tar.gz", 125.5)], "m int, e string, p string, s double")
    r = d.select(X.note_name(F.col("m")).alias("n"), X.display_name(F.col("e")).alias("d"), X.file_parts(F.col("p")).alias("f"), X.clock(F.col("s")).alias("c"), X.is_email(F.col("e")).alias("ok"), X.folded(F.lit(40.0), F.lit(61)).alias("o"), X.half_up(F.lit(-0.5)).alias("h"), X.half_even(F.lit(2.5)).alias("g")).first()
    assert (r.n, r.d, tuple(r.f), r.c, r.ok, r.o, r.h, r.g) == ("C4", "a b c", ("/x", "y.tar", ".gz"), "2:06", True, 64.0, 0, 2.0)


def test_merge_and_delete(spark):
    old = spark.createDataFrame([(1, 5.0, None), (2, 6.0, "b")], "id int, dur double, title string")
    new = spark.createDataFrame([(1, 7.0, "x"), (2, None, "y"), (3, 8.0, "z")], "id int, dur double, title string")
    assert sorted(map(tuple, R.merge(old, new, "id", ["dur"], ["title"]).collect())) == [(1, 7.0, "x"), (2, 6.0, "b"), (3, 8.0, "z")]
    kids = spark.createDataFrame([(1,), (2,), (None,)], "pid int")
    left = R.delete_cascade(old, "id", old.where("id = 1").select("id"), {"kids": (kids, "pid")})
    assert left["parent"].count() == 1 and sorted(r.pid or 0 for r in left["kids"].collect()) == [0, 2]


def test_falsy(spark):
    d = spark.createDataFrame([(0.0, "", 3.0), (None, "a", 4.0), (2.0, None, 5.0)], "a double, s string, b double")
    got = d.select(R.falsy_coalesce(F.col("a"), F.col("b")).alias("x"), R.falsy_coalesce(F.col("s"), F.lit("z")).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(3.0, "z"), (4.0, "a"), (2.0, "z")]


def test_results_and_quarantine(spark):
    p = spark.createDataFrame([(1, "s", '{"notes":[[3,0.9,12],[null,0,null],[1],[2,0.7]]}', 88.12361, 3), (2, "s", "nope", 101.0, 1), (3, "s", None, 5.0, -1)], "id int, song_id string, results string, score double, max_combo int")
    assert [(r.pos, r.rating, r.acc, r.cents) for r in ingest.note_results(p).collect()] == [(0, 3, 0.9, 12.0), (1, None, 0.0, None), (3, 2, 0.7, None)]
    assert [(r.id, r.score) for r in ingest.accepted(p).collect()] == [(1, 88.124)] and sorted(r.reason for r in ingest.rejected(p).collect()) == ["negative combo", "score out of bounds"]


def test_song_maps(spark, tmp_path):
    (tmp_path / "song_map_v1.json").write_text('{"duration": 9.0, "n_pages": 0, "page_flips": [4.0], "notes": [{"k": 1, "t_start": 0.5, "t_end": 1.0, "midi": 60}]}')
    (tmp_path / "song_map_v2.json").write_text('{"duration": 5.0, "n_pages": 3, "pages": [{"vis_a": 0.0, "t_end": 5.0}], "notes": []}')
    m = documents.read_maps(spark, str(tmp_path))
    got = {r.song_id: (r.n_notes, r.n_pages, r.anchored) for r in documents.summaries(m).collect()}
    assert got == {"v1": (1, 0, True), "v2": (0, 3, False)}
    assert sorted((r.song_id, r.pos, r.vis_a, r.t_end) for r in documents.page_rows(m).collect()) == [("v1", 0, 0.0, 4.0), ("v1", 1, 4.0, 9.0), ("v2", 0, 0.0, 5.0)]
    assert documents.note_rows(m).first().midi == 60 and documents.catalogue(spark, str(tmp_path)).count() == 2


def test_folds_over_bars(spark):
    bars = lambda *xs: spark.createDataFrame([(1, i, *x) for i, x in enumerate(xs)], "k int, i int, x0 double, x1 double, cy double")
    near = I.cluster_bars(bars((10.0, 30.0, 5.0), (15.0, 35.0, 6.0), (100.0, 120.0, 5.0)), ["k"], ["i"]).collect()
    assert sorted(r.seen for r in near) == [1, 2]
    assert len(I.cluster_bars(bars((10.0, 30.0, 5.0), (19.0, 30.0, 5.0)), ["k"], ["i"]).collect()) == 2
    kept = I.suppress_overlaps(bars((0.0, 10.0, 1.0), (1.0, 11.0, 2.0), (30.0, 31.0, 0.0)), ["k"], "i", [("cy", True)], "x0", "x1")
    assert sorted(r.i for r in kept.collect()) == [1, 2]
    inside = I.drop_contained(bars((0.0, 10.0, 1.0), (2.0, 3.0, 1.0), (2.0, 3.0, 7.0)), ["k"], "i", "cy", "x0", "x1")
    assert sorted(r.i for r in inside.collect()) == [0, 2]
    seen = I.track(bars((0.0, 10.0, 1.0), (0.0, 12.0, 1.0), (50.0, 60.0, 1.0)), ["k"], "i").collect()
    assert sorted(r.hits for r in seen) == [1, 2]


def _largest_groups(monkeypatch, module):
    """The rows of the largest group of each fold that the module begins."""
    sizes, fold = [], module.fold_groups

    def seen(df, keys, *args, **kw):
        sizes.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return fold(df, keys, *args, **kw)

    monkeypatch.setattr(module, "fold_groups", seen)
    return sizes


def test_lattice_folds_counts_of_heights(spark, monkeypatch):
    sizes = _largest_groups(monkeypatch, B)
    rows = [("a", 3.0 + 7.5 * (i % 5)) for i in range(3000)] + [("a", None), ("b", None)]
    d = spark.createDataFrame(rows, "k string, y double")
    one = spark.createDataFrame([("a", 3.0 + 7.5 * i) for i in range(5)], "k string, y double")
    assert B.lattice_fit(d, ["k"], "y").collect() == B.lattice_fit(one, ["k"], "y").collect()
    assert sizes == [5, 5]


def test_anchored_sessions_fold_islands(spark, monkeypatch):
    sizes = _largest_groups(monkeypatch, S)
    rng = random.Random(4)
    rows = [(u, t * 1.0) for u in range(3) for base in range(0, 40_000, 100) for t in sorted(rng.randrange(base, base + 60) for _ in range(rng.randint(0, 9)))]
    d = spark.createDataFrame(rows + [(1, None), (9, None)], "u int, t double").repartition(5)
    for width, least, apart in ((3.0, 1, 0.0), (7.0, 2, 20.0), (5.0, 3, 9.0)):
        want = []
        for u in range(3):
            places, kept = sorted(t for v, t in rows if v == u), []
            while places:
                near = [t for t in places if t - places[0] <= width]
                if len(near) < least:
                    places = [t for t in places if t > places[0]]
                    continue
                if kept and near[-1] - kept[-1][1] < apart:
                    kept.pop()
                kept.append((u, near[-1], len(near)))
                places = [t for t in places if t > near[-1]]
            want += kept
        assert sorted((r.u, r.t, r.n) for r in S.anchored_sessions(d, ["u"], "t", width, least, apart).collect()) == want
    assert max(sizes) <= 20  # a user has some 1800 rows


def test_bar_clusters_are_of_a_song_and_page(spark):
    from cadenza.plans import registry

    assert registry.QUERIES["bar_clusters"](spark, "/root/testdata/sf0.001").columns[:2] == ["song_id", "page"]


def test_periods_are_filled_to_the_ends(spark):
    d = spark.createDataFrame([(1, 10.0), (1, 16.0), (2, 3.0)], "s int, t double")
    got = sorted((r.s, r.t, r.filled) for r in S.fill_periods(d, ["s"], "t", 3.0, start=F.lit(2.0), end=F.lit(22.0)).collect())
    assert got == [(1, 1.0, True), (1, 4.0, True), (1, 7.0, True), (1, 10.0, False), (1, 13.0, True), (1, 16.0, False), (1, 19.0, True),
                   (2, 0.0, True), (2, 3.0, False), (2, 6.0, True), (2, 9.0, True), (2, 12.0, True), (2, 15.0, True), (2, 18.0, True), (2, 21.0, True)]


def test_interpolation_bounds_its_slope(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, None), (1, 2.0, 10.0), (1, 3.0, None), (1, 4.0, 500.0), (1, 5.0, None), (1, 6.0, 400.0)], "s int, t double, v double")
    assert [r.filled for r in S.interpolate(d, ["s"], "t", "v", 3.0, slopes=(0.0, 180.0)).orderBy("t").collect()] == [0.0, 5.0, 10.0, None, 500.0, None, 400.0]
