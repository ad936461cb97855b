"""Column functions, ranks and snapshots that the queries use little of."""

import random

from pyspark.sql import functions as F

from cadenza.functions import scalars as X
from cadenza.operators import relational as O, robust as R, sequence as S
from cadenza.sources import documents


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_times_and_addresses(spark):
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    ago = lambda t: spark.range(1).select(X.ago(F.lit(t).cast("timestamp"), now).alias("x")).first().x
    assert [ago(t) for t in ("2024-03-01 11:59:30", "2024-03-01 11:15:00", "2024-03-01 02:00:00", "2024-02-20 12:00:00", "2023-12-31 12:00:00")] == ["now", "45m", "10h", "10d", "2023/12/31"]
    assert one(spark, X.client_ip(F.lit(" 1.2.3.4 , 5.6.7.8"), F.lit("9.9.9.9"))) == "1.2.3.4" and one(spark, X.client_ip(F.lit(None).cast("string"), F.lit("9.9.9.9"))) == "9.9.9.9"
    assert one(spark, X.codec(F.lit("Stream #0:0: Video: av1 (Main)"))) == "av1" and one(spark, X.codec(F.lit("Audio: aac"))) is None
    assert one(spark, R.hue_distance(F.lit(178), F.lit(3))) == 5 and one(spark, R.hue_distance(F.lit(3), F.lit(178))) == 5
    t = X.sweep_time(F.lit(200.0), F.lit(1.5), F.lit(100.0))
    assert one(spark, t) == 3.5 and one(spark, X.sweep_place(t, F.lit(1.5), F.lit(100.0))) == 200.0 and one(spark, X.sweep_time(F.lit(1.0), F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, X.shown_at(F.lit(5.0), F.lit(1.0))) == 2.8 and one(spark, X.shown_at(F.lit(2.0), F.lit(1.0))) == 1.0
    assert one(spark, R.lattice_row(X.lattice_place(F.lit(4), F.lit(7.5), F.lit(3.0)), 7.5, 3.0)) == 4
    assert one(spark, X.stale(F.lit(None).cast("timestamp"), now)) and one(spark, X.escaped(F.lit("<a href='x'>&\""))) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"


def test_segments(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.1, 50.0), (1, 0.2, 100.0), (1, 0.3, 10.0), (1, 0.4, 20.0), (1, 2.0, 30.0)], "k int, t double, x double")
    assert [r.segment for r in S.segments(d, ["k"], "t", "x").orderBy("t").collect()] == [1, 1, 1, 2, 2, 3]


def test_ranks_of_hot_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab") if rng.random() > 0.02 else None, rng.choice([None, *range(40)])) for _ in range(800)]
    d = spark.createDataFrame(rows, "k string, v int").repartition(5)
    for keys in (["k"], []):
        for down in (True, False):
            got = sorted((str(r.k), str(r.v), r.rank) for r in O.ranked(d, keys, "v", descending=down, each=50).collect())
            better = lambda a, b: b is not None and (a is None or (b > a if down else b < a))
            assert got == sorted((str(k), str(v), 1 + sum(better(v, w) for q, w in rows if q == k or not keys)) for k, v in rows)


def test_snapshots(spark):
    c = spark.createDataFrame([("a", 2), ("b", None)], "k string, n int")
    assert sorted(tuple(r) for r in O.counted_up(c, "k", "n", spark.createDataFrame([("a",), ("a",), ("c",)], "k string")).collect()) == [("a", 4), ("b", 0), ("c", 1)]
    assert sorted((r.k, r.n) for r in O.assigned(c, "k", spark.createDataFrame([("a", None)], "k string, n int")).fillna(-1).collect()) == [("a", -1), ("b", -1)]
    assert O.plausible(c, c.limit(0), 0.5).count() == 2 and O.plausible(c.limit(0), c, 0.5).count() == 2 and O.plausible(c.limit(1), c, 0.5).count() == 1


def test_maps_are_written_anew(spark, tmp_path):
    maps = spark.createDataFrame([("s1", 3.5, [1, 2]), ("s2", None, None)], "song_id string, duration double, pages array<int>")
    first, second = documents.write_maps(maps, str(tmp_path)), documents.write_maps(maps.limit(1), str(tmp_path))
    assert first != second and spark.read.json(first).count() == 2 and spark.read.json(second).count() == 1
    assert {r.song_id: r.duration for r in spark.read.json(first).collect()} == {"s1": 3.5, "s2": None}
