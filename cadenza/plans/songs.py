"""Feeds with songs, visibility, session ends, frames joined to notes, and the smaller snapshot and column operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cadenza.functions import scalars as X
from cadenza.operators import relational as O, scoring as C, sequence as S
from cadenza.operators.joins import interval_pairs
from cadenza.plans.live import CREDIT, FRAMES, RESULTS, frames
from cadenza.plans.matches import SPLIT, _bars
from cadenza.plans.registry import query
from cadenza.plans.views import NOTES, PLAYS, USERS, notes, plays, table, users

#: A play's song, as a row of `part`.
PART_OF_PLAY = "CAST(props->>'k' AS BIGINT) + 1"
SUNG = f"{PLAYS}, sung AS (SELECT plays.*, {PART_OF_PLAY} AS part FROM plays)"


def sung(spark, sf_dir):
    return plays(spark, sf_dir).withColumn("part", F.get_json_object("props", "$.k").cast("long") + 1)


def titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("title"))


@query(f"WITH {SUNG} SELECT user_id, id, p_name AS title, score, played_at FROM sung JOIN part ON p_partkey = part WHERE completed = 1")
def personal_history(spark, sf_dir):
    """Every user's finished plays with the songs' titles."""
    return sung(spark, sf_dir).where("completed = 1").join(titles(spark, sf_dir), "part").select("user_id", "id", "title", "score", "played_at")


@query(f"WITH {SUNG}, {USERS} SELECT id, display_name, p_name AS title, score, played_at FROM sung JOIN users USING (user_id) JOIN part ON p_partkey = part WHERE completed = 1 ORDER BY played_at DESC, id DESC LIMIT 30")
def recent_feed_with_songs(spark, sf_dir):
    """The last finished plays with their singers and songs: both joins come before the limit, as either may drop a row."""
    d = sung(spark, sf_dir).where("completed = 1").join(users(spark, sf_dir), "user_id").join(titles(spark, sf_dir), "part")
    return d.orderBy(F.desc("played_at"), F.desc("id")).limit(30).select("id", "display_name", "title", "score", "played_at")


@query(f"WITH {SUNG} SELECT user_id, part, max(played_at) AS last_play, count(*) AS n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(played_at) DESC, part) AS INT) AS place FROM sung WHERE completed = 1 GROUP BY 1, 2")
def songs_by_last_play(spark, sf_dir):
    """Every user's songs, the last sung first."""
    d = sung(spark, sf_dir).where("completed = 1").groupBy("user_id", "part").agg(F.max("played_at").alias("last_play"), F.count("*").alias("n"))
    return d.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last_play"), "part")))


@query("""SELECT p_partkey, status = 'published' AS for_all, true AS for_admins FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'hidden' ELSE 'labeling' END AS status FROM part) WHERE status = 'published' OR p_size > 10""")
def visible_songs(spark, sf_dir):
    """Songs that a user sees: published ones, and all to those who may (here by size, in place of a role)."""
    status = F.when(F.col("p_size") % 3 == 0, "published").when(F.col("p_size") % 3 == 1, "hidden").otherwise("labeling")
    d = table(spark, sf_dir, "part").withColumn("status", status)
    return d.where(visible(F.col("status"), F.col("p_size") > 10)).select("p_partkey", (F.col("status") == "published").alias("for_all"), F.lit(True).alias("for_admins"))


def visible(status, is_admin):
    """Whether a song of this status may be seen."""
    return (status == "published") | is_admin


@query(f"""WITH {NOTES}, p AS (SELECT song_id, list(a ORDER BY page) AS starts FROM (SELECT song_id, page, min(t_start) AS a FROM notes GROUP BY 1, 2) GROUP BY 1)
SELECT song_id, pos, coalesce(starts[pos + 1], 0.0::DOUBLE) AS starts_at FROM p, range(0, 9, 2) r(pos)""")
def section_starts(spark, sf_dir):
    """When the page at a place of a song's list begins; 0 where the list has no such place."""
    p = notes(spark, sf_dir).groupBy("song_id", "page").agg(F.min("t_start").alias("a")).groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("page", "a"))).alias("p"))
    d = p.select("song_id", "p", F.explode(F.expr("sequence(0L, 8L, 2L)")).alias("pos"))
    return d.select("song_id", "pos", F.coalesce(F.get("p", F.col("pos").cast("int"))["a"], F.lit(0.0)).alias("starts_at"))


@query(f"""WITH {RESULTS}, s AS (SELECT session_id, song_id, count_if(rating IS NOT NULL) AS n_attempted, count(*) AS n_passed FROM r GROUP BY 1, 2), m AS (SELECT song_id, count(*) AS n FROM notes GROUP BY 1),
q AS (SELECT session_id, sum(CASE WHEN rating IS NOT NULL THEN least(hit, t_end - t_start) END) AS h, sum(CASE WHEN rating IS NOT NULL THEN t_end - t_start END) AS d FROM r GROUP BY 1),
t AS (SELECT s.session_id, '{{"notes":[' || string_agg('[' || coalesce(CAST(rating AS VARCHAR), 'null') || ',' || CASE WHEN rating IS NULL THEN '0' ELSE CAST(round(acc, 3) AS VARCHAR) END || ',' || CASE WHEN rating IS NULL OR cents IS NULL THEN 'null' ELSE CAST(CAST(round(cents) AS BIGINT) AS VARCHAR) END || ']', ',' ORDER BY n.pos) || ']}}' AS results
  FROM s JOIN notes n USING (song_id) LEFT JOIN r ON r.session_id = s.session_id AND r.pos = n.pos GROUP BY 1)
SELECT session_id, song_id, n_passed = n AS completed, round(coalesce(CASE WHEN d >= 0.5 THEN 100 * pow(h / d, 0.7) END, 0), 3) AS score, results FROM s JOIN m USING (song_id) JOIN q USING (session_id) JOIN t USING (session_id) WHERE n_attempted > 0""")
def session_ends(spark, sf_dir):
    """The row that each session leaves when it is finished or quit; none if nothing was attempted."""
    f = frames(spark, sf_dir)
    n = notes(spark, sf_dir, f)
    return C.finished(C.note_results(f, n), n).select("session_id", "song_id", "completed", "score", "results")


@query(f"""
WITH RECURSIVE {CREDIT}, p AS (SELECT session_id, t, midi, note_midi, row_number() OVER (PARTITION BY session_id ORDER BY t) AS i FROM k WHERE midi IS NOT NULL),
s AS (SELECT session_id, i, t, midi + 12 * floor((coalesce(note_midi, midi) - midi) / 12 + 0.5) AS shown FROM p WHERE i = 1
  UNION ALL SELECT p.session_id, p.i, p.t, p.midi + 12 * floor((coalesce(p.note_midi, s.shown) - p.midi) / 12 + 0.5) FROM s JOIN p ON p.session_id = s.session_id AND p.i = s.i + 1)
SELECT session_id, t, shown FROM s""")
def shown_pitches(spark, sf_dir):
    """The pitch that is drawn for each frame, in the octave of the note or of what was drawn last."""
    return C.shown_pitches(C.frame_credits(frames(spark, sf_dir), notes(spark, sf_dir, frames(spark, sf_dir))))


def numbered_frames(spark, sf_dir):
    return frames(spark, sf_dir).select("song_id", (F.col("t") * 4).cast("long").alias("frame"), "midi")


NUMBERED = f"{FRAMES}, f AS (SELECT song_id, CAST(t * 4 AS BIGINT) AS frame, midi FROM frames)"


@query(f"""WITH {NOTES}, {NUMBERED} SELECT n.song_id, n.pos, count(*) AS n_frames, round(avg(f.midi), 6) AS mean_midi FROM notes n JOIN f ON f.song_id = n.song_id
AND frame BETWEEN ceil(4 * (t_start + 0.15 * (t_end - t_start))) AND floor(4 * (t_start + 0.85 * (t_end - t_start))) GROUP BY 1, 2""")
def note_energies(spark, sf_dir):
    """The mean over the frames in the middle 70 % of every note: the notes' frame numbers joined to the table of frames."""
    at = lambda share: 4 * (F.col("t_start") + share * (F.col("t_end") - F.col("t_start")))
    f = numbered_frames(spark, sf_dir)
    n = notes(spark, sf_dir, f).select("song_id", "pos", F.ceil(at(0.15)).alias("a"), F.floor(at(0.85)).alias("b")).where("a <= b").select("song_id", "pos", F.explode(F.sequence("a", "b")).alias("frame"))
    d = n.join(f, ["song_id", "frame"])
    return d.groupBy("song_id", "pos").agg(F.count("*").alias("n_frames"), F.round(F.avg("midi"), 6).alias("mean_midi"))


@query(f"WITH {NUMBERED} SELECT song_id, frame, midi FROM f WHERE frame % 3 = 0")
def strided_frames(spark, sf_dir):
    """Every third frame of every song: a filter on the frame's number."""
    return numbered_frames(spark, sf_dir).where(F.pmod("frame", F.lit(3)) == 0)


@query(f"""WITH {NOTES}, {NUMBERED}, q AS (SELECT song_id, pos, unnest(['b', 'a']) AS role, unnest([CAST(4 * t_start AS BIGINT) - 1, CAST(4 * t_start AS BIGINT) + 1]) AS frame FROM notes)
SELECT song_id, pos, max(CASE WHEN role = 'b' THEN midi END) AS before, max(CASE WHEN role = 'a' THEN midi END) AS after FROM q JOIN f USING (song_id, frame) GROUP BY 1, 2""")
def requested_frames(spark, sf_dir):
    """What the frames show before and after each note begins: all requests are gathered first and joined to the frames,
    which are read once."""
    at = (4 * F.col("t_start")).cast("long")
    q = notes(spark, sf_dir).select("song_id", "pos", F.explode(F.array(F.struct(F.lit("b").alias("role"), (at - 1).alias("frame")), F.struct(F.lit("a").alias("role"), (at + 1).alias("frame")))).alias("q")).select("song_id", "pos", "q.*")
    d = q.join(numbered_frames(spark, sf_dir), ["song_id", "frame"])
    of = lambda r: F.max(F.when(F.col("role") == r, F.col("midi")))
    return d.groupBy("song_id", "pos").agg(of("b").alias("before"), of("a").alias("after"))


@query(f"WITH {NOTES}, {SPLIT} SELECT song_id, pos FROM bars b WHERE NOT EXISTS (SELECT 1 FROM shots s WHERE s.song_id = b.song_id AND least(s.x1, b.x1) - greatest(s.x0, b.x0) > 0.4 * (b.x1 - b.x0))")
def missed_bars(spark, sf_dir):
    """Bars of which no note of the map covers more than 0.4 of the width."""
    bars, shots = _bars(spark, sf_dir)
    enough = F.least("s1", "x1") - F.greatest("s0", "x0") > 0.4 * (F.col("x1") - F.col("x0"))
    return interval_pairs(bars, shots, ["song_id"], ("x0", "x1"), ("s0", "s1"), 64.0, "left_anti", enough, ["pos"]).select("song_id", "pos")


@query(f"WITH {NOTES}, g AS (SELECT DISTINCT song_id, CAST(unnest(range(0, 60, 6)) AS DOUBLE) AS t FROM notes) SELECT g.song_id, g.t, count(*) AS n FROM g JOIN notes n ON n.song_id = g.song_id AND t_start BETWEEN t - 2.2 AND t + 5.2 GROUP BY 1, 2")
def notes_in_view(spark, sf_dir):
    """How many notes begin in the window that is drawn at each time of a grid."""
    n = notes(spark, sf_dir).select("song_id", F.col("t_start").alias("s0"), F.col("t_start").alias("s1"))
    g = n.select("song_id").distinct().select("song_id", F.explode(F.expr("transform(sequence(0, 54, 6), x -> cast(x AS double))")).alias("t")).withColumns({"v0": F.col("t") - 2.2, "v1": F.col("t") + 5.2})
    return interval_pairs(g, n, ["song_id"], ("v0", "v1"), ("s0", "s1"), 8.0).groupBy("song_id", "t").agg(F.count("*").alias("n"))


@query(f"WITH {NOTES}, s AS (SELECT song_id, list(x1 - x0 ORDER BY x1 - x0) AS w FROM notes GROUP BY 1) SELECT song_id, w[len(w) // 2 + 1] AS width FROM s")
def upper_medians(spark, sf_dir):
    """The upper median of the widths of a song's bars."""
    w = F.sort_array(F.collect_list(F.col("x1") - F.col("x0")))
    return notes(spark, sf_dir).groupBy("song_id").agg(w.alias("w")).select("song_id", F.get("w", F.floor(F.size("w") / 2).cast("int")).alias("width"))


@query(f"""WITH {NOTES}, h AS (SELECT song_id, midi % 12 AS pc, max(c) AS best FROM (SELECT song_id, midi, sum(t_end - t_start) AS c FROM notes GROUP BY 1, 2) GROUP BY 1, 2)
SELECT song_id, pc, best, CAST(row_number() OVER (PARTITION BY song_id ORDER BY best DESC, pc) AS INT) AS rank FROM h""")
def pitch_class_bests(spark, sf_dir):
    """The best of each pitch class over its octaves, ranked within the song."""
    h = notes(spark, sf_dir).groupBy("song_id", "midi").agg(F.sum(F.col("t_end") - F.col("t_start")).alias("c")).groupBy("song_id", (F.col("midi") % 12).alias("pc")).agg(F.max("c").alias("best"))
    return h.withColumn("rank", F.row_number().over(W.partitionBy("song_id").orderBy(F.desc("best"), "pc")))


@query(f"""WITH {NOTES}, n AS (SELECT song_id, t_start AS t, min(x0) AS x FROM notes GROUP BY 1, 2), l AS (SELECT *, t - lag(t) OVER w AS gap, lag(x) OVER w AS px, max(x) OVER (PARTITION BY song_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING) AS top FROM n WINDOW w AS (PARTITION BY song_id ORDER BY t)),
m AS (SELECT DISTINCT ON (song_id) l.song_id, t FROM l WHERE t >= 20 ORDER BY song_id, t)
SELECT l.song_id, l.t, CAST(sum(CASE WHEN gap IS NULL OR gap > 12 OR (px - x > 150 AND top < px - 100) OR m.t IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY l.song_id ORDER BY l.t) AS BIGINT) AS page FROM l LEFT JOIN m ON m.song_id = l.song_id AND m.t = l.t""")
def page_splits(spark, sf_dir):
    """Pages of a song's trace, by gaps, falls that last and a known flip at 20 s."""
    d = notes(spark, sf_dir).groupBy("song_id", F.col("t_start").alias("t")).agg(F.min("x0").alias("x"))
    flips = d.select("song_id").distinct().withColumn("mark", F.lit(20.0))
    return S.page_splits(d, ["song_id"], "t", "x", 12.0, 150.0, 100.0, 6.0, flips).select("song_id", "t", "page")


@query(f"""
WITH {NOTES}, d AS (SELECT song_id, t_start AS t, min(x0) AS x FROM notes GROUP BY 1, 2), near AS (SELECT a.song_id, a.t, b.t AS u, b.x AS y FROM d a JOIN d b ON a.song_id = b.song_id AND abs(a.t - b.t) <= 12),
s AS (SELECT p.song_id, p.t, median((q.y - p.y) / (q.u - p.u)) AS slope FROM near p JOIN near q ON p.song_id = q.song_id AND p.t = q.t AND q.u > p.u GROUP BY 1, 2),
r AS (SELECT song_id, t, any_value(slope) AS slope, median(y - slope * u) AS rest, count(*) AS n FROM near JOIN s USING (song_id, t) GROUP BY 1, 2)
SELECT d.song_id, d.t, d.x, CASE WHEN n > 2 AND abs(x - slope * d.t - rest) > 150 THEN NULL ELSE x END AS cleaned FROM d LEFT JOIN r USING (song_id, t)""")
def cleaned_traces(spark, sf_dir):
    """Places of a song's trace that lie on the line of their neighbours."""
    d = notes(spark, sf_dir).groupBy("song_id", F.col("t_start").alias("t")).agg(F.min("x0").alias("x"))
    return S.reject_outliers(d, ["song_id"], "t", "x", 12.0, 150.0).select("song_id", "t", "x", "cleaned")


@query("""WITH b AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, event_id FROM b WHERE (p < 100 AND value >= 100 AND value - p < 60) OR ((p IS NULL OR p - value > 200) AND value BETWEEN 100 AND 145)""")
def level_arrivals(spark, sf_dir):
    """Events at which a user's value arrives at 100, from below or anew."""
    return S.arrivals(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", F.lit(100.0)).select("user_id", "event_id")


@query("""WITH v AS (SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS t, CASE WHEN event_type <> 'click' THEN value END AS v FROM events),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS ta, last_value(v IGNORE NULLS) OVER p AS va, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER q AS tb, first_value(v IGNORE NULLS) OVER q AS vb FROM v
  WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(v, CASE WHEN tb - ta <= 4000 AND vb - va >= 0 AND vb - va < 0.5 * (tb - ta) THEN va + (vb - va) * (t - ta) / (tb - ta) END), 6) AS filled FROM k""")
def bounded_values(spark, sf_dir):
    """Missing values between two known ones, if the line between them rises by less than a half."""
    d = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), F.when(F.col("event_type") != "click", F.col("value")).alias("v"))
    return S.interpolate(d, ["user_id"], "t", "v", 4000.0, slopes=(0.0, 0.5)).select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@query(f"""WITH {NOTES}, p AS (SELECT song_id, 10 + 3.0::DOUBLE * min(page) AS a, 10 + 3.0::DOUBLE * max(page) AS b FROM notes GROUP BY 1)
SELECT song_id, a + 3 * i AS t, a + 3 * i < a OR a + 3 * i > b AS extended FROM p, range(-40, 40) r(i) WHERE (a + 3 * i >= a OR a + 3 * (i + 1) > 2) AND (a + 3 * i <= b OR a + 3 * i < 44)""")
def extended_pages(spark, sf_dir):
    """Page starts with a period of three, filled in and carried on to both ends of the song."""
    p = notes(spark, sf_dir).groupBy("song_id").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    at = lambda k: (10 + 3 * F.col(k)).cast("double")
    p = p.where("song_id IS NOT NULL").select("song_id", at("lo").alias("a"), at("hi").alias("b"))
    p = p.select("*", F.explode(F.array_distinct(F.array("a", "b"))).alias("t"))
    # a song's ends go along as keys
    d = S.fill_periods(p, ["song_id", "a", "b"], "t", 3.0, start=F.lit(2.0), end=F.lit(44.0))
    return d.select("song_id", "t", ((F.col("t") < F.col("a")) | (F.col("t") > F.col("b"))).alias("extended"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 3 THEN o_custkey END AS owner FROM orders""")
def detached_orders(spark, sf_dir):
    """Orders of deleted customers stay and belong to nobody."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    gone = o.where("owner % 10 = 3").select("owner").distinct()
    return O.delete_cascade(c, "c_custkey", gone, {}, {"orders": (o, "owner")})["orders"]


@query("""SELECT c_custkey AS id, c_nationkey + coalesce(n, 0) AS attempts FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey""")
def counted_attempts(spark, sf_dir):
    """A counter of every user with one more for each event."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("attempts"))
    return O.counted_up(c, "id", "attempts", table(spark, sf_dir, "events").select(F.col("user_id").alias("id")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS stage FROM orders""")
def assigned_orders(spark, sf_dir):
    """An update by key that also sets values to null."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stage"))
    changes = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(None).cast("string").alias("status"), F.lit("x").alias("stage"))
    return O.assigned(o, "o_orderkey", changes)


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey + 10000000 FROM orders""")
def gated_snapshots(spark, sf_dir):
    """Two writes behind a check: one that leaves half of the rows passes, one that leaves a tenth is set aside."""
    old = table(spark, sf_dir, "orders").select("o_orderkey")
    shifted = old.select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"))
    return O.plausible(old.where("o_orderkey % 2 = 0"), old, 0.3).unionByName(O.plausible(shifted.where("o_orderkey % 10 = 0"), shifted, 0.3))


@query("""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS url,
replace(replace(replace(replace(replace(html[:200], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM pages WHERE html IS NOT NULL""")
def escaped_pages(spark, sf_dir):
    """Addresses and the beginnings of pages as they may stand in HTML."""
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", X.escaped(F.col("url")).alias("url"), X.escaped(F.substring("html", 1, 200)).alias("html"))


@query("""SELECT event_id, ['ド', 'ド#', 'レ', 'レ#', 'ミ', 'ファ', 'ファ#', 'ソ', 'ソ#', 'ラ', 'ラ#', 'シ'][1 + CAST(props->>'k' AS INT) % 12] AS name_jp, date_trunc('hour', ts) <> date_trunc('hour', ts + INTERVAL 20 MINUTE) AS stale,
list_transform([0, 3, 6], lambda i: (CAST(props->>'k' AS INT) + i)) AS every_third, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS one FROM events""")
def event_columns(spark, sf_dir):
    """Japanese note names, staleness by the hour, thinned arrays and overlaid maps."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts")
    maps = X.overlaid(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(5)), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(2))).otherwise(F.create_map(F.lit("b"), F.lit(3))))
    return table(spark, sf_dir, "events").select("event_id", X.note_name_jp(k).alias("name_jp"), X.stale(ts, ts + F.expr("INTERVAL 20 MINUTES")).alias("stale"), X.thinned(F.sequence(k, k + 20), 3, 3).alias("every_third"), maps["a"].alias("one"))
