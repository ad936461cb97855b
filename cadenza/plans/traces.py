"""Queries of the folds over traces and bars, and of frames of sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.audio import pitch
from cadenza.operators import sequence as S, sweeps as P
from cadenza.operators.joins import count_until
from cadenza.plans.registry import query
from cadenza.plans.views import NOTES, notes, table


@query()
def smoothed_traces(spark, sf_dir):
    """The trace of a song that follows its heading, one place at each time."""
    return P.smoothed_track(notes(spark, sf_dir), ["song_id"], "t_start", "x0", gate=200.0, lost=10.0)


@query()
def confirmed_sweeps(spark, sf_dir):
    """Sweeps of a song, a new one where the next note stays back as well."""
    return P.confirmed_sweeps(notes(spark, sf_dir), ["song_id"], "pos")


@query()
def merged_pages(spark, sf_dir):
    """Sweeps on one line taken as one page."""
    d = S.segments(notes(spark, sf_dir), ["song_id"], "t_start", "x0", 200.0, 20.0)
    return P.swept_pages(d, ["song_id"], "segment", "t_start", "x0", points=2, lasts=1.0, rates=(1.0, 1200.0), off=200.0, same=150.0, apart=40.0)


@query(f"""
WITH RECURSIVE {NOTES}, o AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY t_start, pos) AS i FROM notes),
k AS (SELECT song_id, pos, i, true AS taken, [struct_pack(x0 := x0, x1 := x1, cy := cy)] AS kept FROM o WHERE i = 1
  UNION ALL SELECT song_id, pos, i, fresh, CASE WHEN fresh THEN list_append(kept, struct_pack(x0 := x0, x1 := x1, cy := cy))[-12:] ELSE kept END
  FROM (SELECT o.song_id, o.pos, o.i, o.x0, o.x1, o.cy, k.kept, len(list_filter(k.kept, lambda b: abs(b.x0 - o.x0) <= 60 AND abs(b.x1 - o.x1) <= 60 AND abs(b.cy - o.cy) <= 60)) = 0 AS fresh FROM k JOIN o ON o.song_id = k.song_id AND o.i = k.i + 1))
SELECT song_id, pos FROM k WHERE taken""")
def distinct_bars(spark, sf_dir):
    """Bars unlike the last twelve that were kept."""
    return P.unlike_recent(notes(spark, sf_dir), ["song_id"], "pos", "t_start", ("x0", "x1", "cy"), near=60.0)


@query(f"""
WITH {NOTES}, c AS (SELECT song_id, t_start, count(*) AS n FROM notes GROUP BY 1, 2), f AS (SELECT song_id, t_start AS first FROM c QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY n DESC, t_start) = 1),
s AS (SELECT c.song_id, t_start AS second FROM c JOIN f USING (song_id) WHERE abs(t_start - first) >= 5 QUALIFY row_number() OVER (PARTITION BY c.song_id ORDER BY n DESC, t_start) = 1)
SELECT song_id, first, second FROM f LEFT JOIN s USING (song_id)""")
def two_snapshots(spark, sf_dir):
    """The time with the most bars, and the best one at least five seconds from it."""
    c = notes(spark, sf_dir).groupBy("song_id", "t_start").agg(F.count("*").alias("n"))
    return P.two_apart(c, ["song_id"], "t_start", "n", 5.0)


@query(f"""
WITH {NOTES}, g AS (SELECT DISTINCT song_id, CAST(unnest(range(0, 60, 10)) AS DOUBLE) AS t FROM notes),
c AS (SELECT g.song_id, g.t, count(n.pos) AS counted, count(CASE WHEN n.pos % 3 <> 0 THEN 1 END) AS mapped FROM g LEFT JOIN notes n ON n.song_id = g.song_id AND n.t_start <= g.t GROUP BY 1, 2),
d AS (SELECT song_id, t, counted - mapped AS deficit, counted - mapped - coalesce(lag(counted - mapped) OVER (PARTITION BY song_id ORDER BY t), 0) AS grown FROM c)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY grown DESC, t) <= 2""")
def worst_deficits(spark, sf_dir):
    """Where the map of a song falls behind its counter most."""
    n = notes(spark, sf_dir)
    g = n.select("song_id").distinct().select("song_id", F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(10))).alias("t")).withColumn("t", F.col("t").cast("double"))
    d = count_until(count_until(g, n, ["song_id"], "t", "t_start", "counted"), n.where("pos % 3 <> 0"), ["song_id"], "t", "t_start", "mapped")
    return P.deficits(d, ["song_id"], "t", "counted", "mapped", 2)


@query(f"""
WITH {NOTES}, m AS (SELECT *, (midi % 10) / 20.0 AS b, (pos % 6) / 5.0 AS a, CASE WHEN page % 2 = 0 THEN (midi % 7) / 7.0 END AS c, (midi % 9) / 8.0 AS w FROM notes)
SELECT CASE WHEN a < 0.4 THEN 'flip' WHEN c < 0.4 THEN 'unstable' WHEN page < 2 AND pos % 2 = 0 AND (a < 0.6 OR b > 0.15) THEN 'seen1' WHEN b <= 0.3 OR (t_start < 9 AND page >= 3) THEN 'accepted'
  WHEN w > 0.5 AND (midi % 5) / 4.0 <= 0.3 AND (pos % 4) / 4.0 >= 0.4 THEN 'accepted washed' ELSE 'flip' END AS verdict, count(*) AS n FROM m GROUP BY 1""")
def evidence_verdicts(spark, sf_dir):
    """How many bars the evidence accepts, and how many each reason rejects."""
    c = F.col
    before, after = (c("midi") % 10) / 20.0, (c("pos") % 6) / 5.0
    v = P.evidence(before, after, F.when(c("page") % 2 == 0, (c("midi") % 7) / 7.0), c("page"), c("pos") % 2 == 0, c("t_start") < 9, (c("midi") % 9) / 8.0, (c("midi") % 5) / 4.0, (c("pos") % 4) / 4.0)
    return notes(spark, sf_dir).select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query()
def frame_pitches(spark, sf_dir):
    """The pitch of every vector taken as a frame of sound."""
    return table(spark, sf_dir, "embeddings").select("vec_id", pitch(F.col("embedding"), 8000.0).alias("midi"))
