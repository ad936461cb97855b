"""A player's statistics: bests, streaks, calendars, pitches and weak sections; and the sequence operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cadenza.operators import sequence as S
from cadenza.plans.registry import query
from cadenza.plans.views import NOTES, PLAYS, notes, plays, table

TODAY = "2024-01-31"


@query(f"""
WITH {PLAYS} SELECT user_id, song_id, count(*) AS n, max(score) AS best, (list(score ORDER BY played_at, id))[1] AS first_score, (list(score ORDER BY played_at DESC, id DESC))[1] AS last_score,
  max(played_at) AS last_play, list(score ORDER BY played_at, id) AS trend FROM plays WHERE completed = 1 GROUP BY 1, 2""")
def song_history(spark, sf_dir):
    """Per singer and song: plays, best, first and last score, and all scores in order."""
    at = F.struct("played_at", "id")
    d = plays(spark, sf_dir).where("completed = 1").groupBy("user_id", "song_id").agg(
        F.count("*").alias("n"), F.max("score").alias("best"), F.min_by("score", at).alias("first_score"), F.max_by("score", at).alias("last_score"),
        F.max("played_at").alias("last_play"), F.sort_array(F.collect_list(F.struct("played_at", "id", "score"))).alias("trend"))
    return d.withColumn("trend", F.col("trend.score"))


@query(f"""
WITH {PLAYS}, b AS (SELECT user_id, song_id, max(score) AS best FROM plays WHERE completed = 1 GROUP BY 1, 2), m AS (SELECT user_id, round(avg(best), 6) AS mean_best, count(*) AS n_songs FROM b GROUP BY 1)
SELECT p.user_id, count(*) AS n_plays, any_value(mean_best) AS mean_best, any_value(n_songs) AS n_songs, count(DISTINCT CAST(played_at + INTERVAL 540 MINUTE AS DATE)) AS n_days, (list(id ORDER BY score DESC, played_at, id))[1] AS best_play
FROM plays p JOIN m USING (user_id) WHERE completed = 1 GROUP BY 1""")
def player_summary(spark, sf_dir):
    """Plays, mean of song bests, songs, local days and the best play of every player."""
    d = plays(spark, sf_dir).where("completed = 1").withColumn("day", S.local_day(F.col("played_at"), -540))
    best = d.groupBy("user_id", "song_id").agg(F.max("score").alias("best")).groupBy("user_id").agg(F.round(F.avg("best"), 6).alias("mean_best"), F.count("*").alias("n_songs"))
    own = d.groupBy("user_id").agg(F.count("*").alias("n_plays"), F.count_distinct("day").alias("n_days"), F.min_by("id", F.struct(-F.col("score"), "played_at", "id")).alias("best_play"))
    return own.join(best, "user_id")


@query(f"""
WITH {PLAYS} SELECT user_id, CAST(played_at + INTERVAL 540 MINUTE AS DATE) AS day, count(*) AS n FROM plays WHERE completed = 1 GROUP BY 1, 2""")
def practice_calendar(spark, sf_dir):
    """Plays per local day."""
    d = plays(spark, sf_dir).where("completed = 1").withColumn("day", S.local_day(F.col("played_at"), -540))
    return d.groupBy("user_id", "day").agg(F.count("*").alias("n"))


@query(f"""
WITH {PLAYS}, d AS (SELECT DISTINCT user_id, CAST(played_at + INTERVAL 540 MINUTE AS DATE) AS day FROM plays WHERE completed = 1),
r AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS run FROM d WHERE day <= DATE '{TODAY}'),
s AS (SELECT user_id, max(day) AS last, count(*) AS length FROM r GROUP BY user_id, run)
SELECT user_id, max(CASE WHEN last >= DATE '{TODAY}' - 1 THEN length ELSE 0 END) AS streak, max(length) AS longest FROM s GROUP BY 1""")
def practice_streaks(spark, sf_dir, today=TODAY):
    """The current streak (up to today or yesterday) and the longest one."""
    d = plays(spark, sf_dir).where("completed = 1").select("user_id", S.local_day(F.col("played_at"), -540).alias("day"))
    d = d.where(F.col("day") <= F.lit(today).cast("date"))
    return S.current_and_longest(S.day_streaks(d, ["user_id"], "day"), ["user_id"], F.lit(today).cast("date"))


@query(f"""
WITH {PLAYS}, c AS (SELECT user_id, CAST(played_at AS DATE) AS day, count(*) AS n FROM plays WHERE completed = 1 GROUP BY 1, 2),
s AS (SELECT user_id, CAST(unnest(generate_series(DATE '2024-01-07', DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM c))
SELECT user_id, day, coalesce(n, 0) AS n, CASE WHEN n >= 6 THEN 3 WHEN n >= 3 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END AS level FROM s LEFT JOIN c USING (user_id, day)""")
def calendar_spine(spark, sf_dir):
    """Every day from a Sunday to today with its plays and level."""
    c = plays(spark, sf_dir).where("completed = 1").groupBy("user_id", F.to_date("played_at").alias("day")).agg(F.count("*").alias("n"))
    return S.spine(c, ["user_id"], "day", "n", F.lit("2024-01-07").cast("date"), F.lit(TODAY).cast("date"))


RESULTS = """results AS (SELECT id, user_id, song_id, played_at, pos, CAST((k + pos) % 4 AS INT) AS rating, ((k * 7 + pos * 13) % 100) / 100.0::DOUBLE AS acc, CASE WHEN (k + pos) % 5 <> 0 THEN CAST(k - 50 AS INT) END AS cents, 36 + (k + pos * 5) % 49 AS midi, pos // 2 AS page
  FROM (SELECT *, CAST(unnest(range(0, k % 8)) AS INT) AS pos FROM (SELECT *, CAST(props->>'k' AS INT) AS k FROM plays WHERE completed = 1)))"""


def results(spark, sf_dir):
    """The notes of every play: place, rating, accuracy, cents (null at times), pitch and page."""
    p = plays(spark, sf_dir).where("completed = 1").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    d = p.where("k % 8 > 0").select("*", F.explode(F.sequence(F.lit(0), F.pmod("k", F.lit(8)) - 1)).alias("pos"))
    return d.select(
        "id", "user_id", "song_id", "played_at", "pos", F.pmod(F.col("k") + F.col("pos"), F.lit(4)).alias("rating"), (F.pmod(F.col("k") * 7 + F.col("pos") * 13, F.lit(100)) / 100.0).alias("acc"),
        F.when(F.pmod(F.col("k") + F.col("pos"), F.lit(5)) != 0, F.col("k") - 50).alias("cents"), (F.lit(36) + F.pmod(F.col("k") + F.col("pos") * 5, F.lit(49))).alias("midi"), F.expr("pos div 2").alias("page"))


@query(f"""
WITH {PLAYS}, {RESULTS} SELECT user_id, midi, count(*) AS n, round(avg(acc), 6) AS mean_acc, round(avg(CASE WHEN acc >= 0.28 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(cents), 6) AS mean_cents, count(cents) AS n_cents FROM results GROUP BY 1, 2""")
def accuracy_by_pitch(spark, sf_dir):
    """Attempts, accuracy, hit rate and mean cents of every pitch; skipped notes count as attempts."""
    return results(spark, sf_dir).groupBy("user_id", "midi").agg(
        F.count("*").alias("n"), F.round(F.avg("acc"), 6).alias("mean_acc"), F.round(F.avg((F.col("acc") >= 0.28).cast("double")), 6).alias("hit_rate"),
        F.round(F.avg("cents"), 6).alias("mean_cents"), F.count("cents").alias("n_cents"))


@query(f"""
WITH {PLAYS}, {RESULTS}, l AS (SELECT id FROM plays WHERE completed = 1 QUALIFY row_number() OVER (PARTITION BY user_id, song_id ORDER BY played_at DESC, id DESC) <= 5),
s AS (SELECT user_id, song_id, page, round(avg(acc), 6) AS acc, count(*) AS n FROM results SEMI JOIN l USING (id) GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT user_id, song_id, page, acc, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY acc, song_id, page) AS INT) AS rank FROM s QUALIFY rank <= 6""")
def weak_sections(spark, sf_dir):
    """Each player's six weakest pages over the last five plays of each song, of pages with two notes or more."""
    last = W.partitionBy("user_id", "song_id").orderBy(F.desc("played_at"), F.desc("id"))
    ids = plays(spark, sf_dir).where("completed = 1").withColumn("rn", F.row_number().over(last)).where("rn <= 5").select("id")
    d = results(spark, sf_dir).join(ids, "id", "left_semi").groupBy("user_id", "song_id", "page").agg(F.round(F.avg("acc"), 6).alias("acc"), F.count("*").alias("n")).where("n >= 2")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy("acc", "song_id", "page"))).where("rank <= 6")


@query(f"""
WITH {PLAYS}, {RESULTS}, x AS (SELECT *, CASE WHEN rating > 0 THEN 1 ELSE 0 END AS hit, sum(CASE WHEN rating > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS miss FROM results)
SELECT id, max(c)::BIGINT AS max_combo FROM (SELECT id, sum(hit) OVER (PARTITION BY id, miss ORDER BY pos) AS c FROM x) GROUP BY 1""")
def max_combos(spark, sf_dir):
    """The longest row of notes without a miss in every play."""
    return S.combos(results(spark, sf_dir), ["id"], ["pos"], F.col("rating") > 0).groupBy("id").agg(F.max("combo").alias("max_combo"))


@query(f"""
WITH {NOTES}, n AS (SELECT *, lead(t_start) OVER (PARTITION BY song_id ORDER BY t_start, pos) AS nxt FROM notes)
SELECT song_id, pos, CASE WHEN nxt IS NOT NULL AND t_end > nxt - 0.01 THEN greatest(nxt - 0.01, t_start + 0.05) ELSE t_end END AS t_end FROM n""")
def trimmed_notes(spark, sf_dir):
    """Notes that end before the next one starts, but sound for 50 ms at least."""
    return S.trim_to_next(notes(spark, sf_dir), ["song_id"], ["t_start", "pos"], "t_start", "t_end").select("song_id", "pos", "t_end")


@query(f"""
WITH {NOTES}, n AS (SELECT *, lead(t_start) OVER (PARTITION BY song_id ORDER BY t_start, pos) AS nxt FROM notes) SELECT song_id, sum(CASE WHEN nxt < t_end - 0.001 THEN 1 ELSE 0 END)::BIGINT AS n_overlaps FROM n GROUP BY 1""")
def overlap_counts(spark, sf_dir):
    """How many notes of a song reach into the next one."""
    w = S.by(["song_id"], ["t_start", "pos"])
    d = notes(spark, sf_dir).withColumn("nxt", F.lead("t_start").over(w))
    return d.groupBy("song_id").agg(F.sum(F.when(F.col("nxt") < F.col("t_end") - 0.001, 1).otherwise(0)).alias("n_overlaps"))


@query(f"""
WITH {NOTES}, p AS (SELECT song_id, page, min(t_start) AS vis_a FROM notes GROUP BY 1, 2) SELECT song_id, page, vis_a, coalesce(lead(vis_a) OVER (PARTITION BY song_id ORDER BY vis_a, page), 99.0) AS t_end FROM p""")
def page_ends(spark, sf_dir):
    """A page ends where the next one appears, the last with the song."""
    p = notes(spark, sf_dir).groupBy("song_id", "page").agg(F.min("t_start").alias("vis_a"))
    return S.fill_ends(p, ["song_id"], ["vis_a", "page"], "vis_a", F.lit(99.0))


@query("""
WITH d AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600 THEN 0 ELSE 1 END AS new FROM d),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS n FROM s GROUP BY user_id, island""")
def gap_sessions(spark, sf_dir):
    """Sessions of events at most an hour apart."""
    d = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))
    return S.gap_sessions(d, ["user_id"], "t", 3600.0)


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e),
w AS (SELECT a.user_id, a.i, max(b.i) AS j, max(b.t) AS last, sum(b.n)::BIGINT AS n FROM p a JOIN p b ON a.user_id = b.user_id AND b.t >= a.t AND b.t - a.t <= 1800 GROUP BY 1, 2),
walk AS (SELECT * FROM w WHERE i = 1 UNION ALL SELECT w.* FROM walk JOIN w ON w.user_id = walk.user_id AND w.i = CASE WHEN walk.n >= 2 THEN walk.j ELSE walk.i END + 1)
SELECT user_id, last AS t, n FROM (SELECT *, lead(last) OVER (PARTITION BY user_id ORDER BY last) AS following FROM walk WHERE n >= 2) WHERE following IS NULL OR following - last >= 7200""")
def anchored_sessions(spark, sf_dir):
    """Events within half an hour of a session's first one; sessions of two events or more, two hours apart."""
    d = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))
    return S.anchored_sessions(d, ["user_id"], "t", 1800.0, least=2, apart=7200.0)


@query("""
WITH o AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM o)
SELECT user_id, any_value(event_type) AS event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, island HAVING count(*) >= 2""")
def state_runs(spark, sf_dir):
    """Runs of two or more events of one type."""
    return S.runs(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_type", 2)


CELLS = "CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 1 WHEN 'error' THEN 60 WHEN 'signup' THEN 28 ELSE 255 END"


@query(f"""
WITH RECURSIVE o AS (SELECT user_id, {CELLS} AS cells, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, {CELLS} ORDER BY event_id) AS run FROM events),
r AS (SELECT user_id, cells, min(event_id) AS first_event_id, max(event_id) AS last_event_id FROM o GROUP BY user_id, cells, run HAVING count(*) >= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_event_id) AS i FROM r),
t AS (SELECT n.*, cells AS state, true AS taken FROM n WHERE i = 1
  UNION ALL SELECT n.*, CASE WHEN bit_count(xor(n.cells, t.state)) >= 3 THEN n.cells ELSE t.state END, bit_count(xor(n.cells, t.state)) >= 3 FROM t JOIN n ON n.user_id IS NOT DISTINCT FROM t.user_id AND n.i = t.i + 1)
SELECT user_id, cells, first_event_id, last_event_id FROM t WHERE taken""")
def settled_states(spark, sf_dir):
    """Kinds of event, as cells, that come twice in a row or more and differ in three cells from the kind taken before."""
    d = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(CELLS).alias("cells"))
    return S.settled_states(d, ["user_id"], ["event_id"], "cells", least=2)


@query("""
WITH h AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE value > 100) SELECT user_id, event_id FROM h WHERE before IS NULL OR event_id - before > 200""")
def rising_edges(spark, sf_dir):
    """The first of every stretch of high values at most 200 events apart."""
    return S.refractory_edges(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 100, 200).select("user_id", "event_id")


@query("""
WITH n AS (SELECT user_id, event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS a FROM events)
SELECT user_id, event_id, CASE WHEN len(a) >= 3 THEN (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) / 2 END AS smooth FROM n""")
def smoothed_values(spark, sf_dir):
    """The centred rolling median of nine values."""
    return S.rolling_median(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "smooth")


@query("""
WITH v AS (SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS t, CASE WHEN event_type <> 'click' THEN value END AS v FROM events),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS ta, last_value(v IGNORE NULLS) OVER p AS va, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER q AS tb, first_value(v IGNORE NULLS) OVER q AS vb FROM v
  WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(v, CASE WHEN tb - ta <= 400 THEN va + (vb - va) * (t - ta) / (tb - ta) END), 6) AS filled FROM k""")
def interpolated_values(spark, sf_dir):
    """Missing values between two known ones at most 400 events apart."""
    d = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), F.when(F.col("event_type") != "click", F.col("value")).alias("v"))
    return S.interpolate(d, ["user_id"], "t", "v", 400.0).select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@query("""
WITH p AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id FROM p WHERE before < 100 AND value >= 100""")
def level_crossings(spark, sf_dir):
    """Events at which a user's value rises to 100."""
    return S.crossings(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", F.lit(100.0)).select("user_id", "event_id")


@query(f"""
WITH {NOTES}, x AS (SELECT song_id, pos, max(x1) OVER (PARTITION BY song_id ORDER BY t_start, pos) AS front FROM notes) SELECT * FROM x""")
def running_front(spark, sf_dir):
    """The furthest place that a sweep has reached."""
    return notes(spark, sf_dir).select("song_id", "pos", F.max("x1").over(S.by(["song_id"], ["t_start", "pos"]).rowsBetween(W.unboundedPreceding, 0)).alias("front"))


@query(f"""
WITH {NOTES}, c AS (SELECT song_id, page, count(*) AS n FROM notes GROUP BY 1, 2) SELECT song_id, page, sum(n) OVER (PARTITION BY song_id ORDER BY page)::BIGINT AS through_page FROM c""")
def cumulative_notes(spark, sf_dir):
    """Notes up to and with each page."""
    c = notes(spark, sf_dir).groupBy("song_id", "page").agg(F.count("*").alias("n"))
    return c.select("song_id", "page", F.sum("n").over(S.by(["song_id"], ["page"]).rowsBetween(W.unboundedPreceding, 0)).alias("through_page"))


@query(f"""
WITH {NOTES}, l AS (SELECT *, lag(x0) OVER w AS px, lag(t_start) OVER w AS pt FROM notes WINDOW w AS (PARTITION BY song_id ORDER BY t_start, pos))
SELECT song_id, pos, sum(CASE WHEN px - x0 > 60 OR t_start - pt > 7 OR pt IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY t_start, pos)::BIGINT AS segment FROM l""")
def sweep_segments(spark, sf_dir):
    """Sweeps of a song: a new one where the place falls back or time stands still."""
    n = notes(spark, sf_dir)
    w = S.by(["song_id"], ["t_start", "pos"])
    new = (F.lag("x0").over(w) - F.col("x0") > 60) | (F.col("t_start") - F.lag("t_start").over(w) > 7)
    return S.islands(n, ["song_id"], ["t_start", "pos"], new, "segment").select("song_id", "pos", "segment")


@query(f"""
WITH {NOTES}, p AS (SELECT DISTINCT song_id, CAST(3 * page AS DOUBLE) AS t FROM notes), l AS (SELECT *, lead(t) OVER (PARTITION BY song_id ORDER BY t) AS nxt FROM p),
k AS (SELECT *, round((nxt - t) / 3) AS k FROM l)
SELECT song_id, t + (CASE WHEN k >= 2 THEN (nxt - t) / k ELSE 0 END) * i AS t, i > 0 AS filled FROM (SELECT *, unnest(range(0, CAST(CASE WHEN k >= 2 THEN k ELSE 1 END AS BIGINT))) AS i FROM k)""")
def filled_pages(spark, sf_dir):
    """Page starts with the missing ones of a period of three filled in."""
    p = notes(spark, sf_dir).select("song_id", (3 * F.col("page")).cast("double").alias("t")).distinct()
    return S.fill_periods(p, ["song_id"], "t", 3.0)


@query(f"""
WITH {NOTES}, a AS (SELECT song_id, list(x0 ORDER BY pos) AS xs FROM notes GROUP BY 1) SELECT song_id, round(list_reduce(xs, lambda a, x: 0.7::DOUBLE * a + (1 - 0.7::DOUBLE) * x), 10) AS centre FROM a""")
def smoothed_centre(spark, sf_dir):
    """The exponential mean of the places of a song's notes."""
    a = notes(spark, sf_dir).groupBy("song_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x0"))), lambda s: s["x0"]).alias("xs"))
    return a.select("song_id", F.round(S.ema(F.col("xs")), 10).alias("centre"))
