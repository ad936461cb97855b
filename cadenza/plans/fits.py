"""Queries of the robust fits and of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import intervals as I, robust as R
from cadenza.operators.dedupe import dedupe_sweep
from cadenza.operators.selection import quantiles
from cadenza.operators.sweeps import confirmed_sweeps
from cadenza.plans.registry import query
from cadenza.plans.views import NOTES, notes, table


@query(f"""
WITH {NOTES}, s AS (SELECT a.song_id, median((b.x0 - a.x0) / (b.t_start - a.t_start)) AS slope FROM notes a JOIN notes b ON a.song_id = b.song_id AND b.t_start > a.t_start GROUP BY 1)
SELECT song_id, round(slope, 9) AS slope, round(median(x0 - slope * t_start), 9) AS intercept, count(*) AS n FROM notes JOIN s USING (song_id) GROUP BY song_id, slope""")
def sweep_lines(spark, sf_dir):
    """The robust line of place over time of every song: median slope of all pairs, then median rest."""
    d = R.theil_sen(notes(spark, sf_dir), ["song_id"], "t_start", "x0")
    return d.select("song_id", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"), "n")


@query(f"""
WITH {NOTES}, s AS (SELECT a.song_id, median((b.x0 - a.x0) / (b.t_start - a.t_start)) AS slope FROM notes a JOIN notes b ON a.song_id = b.song_id AND b.t_start > a.t_start GROUP BY 1)
SELECT song_id, round(slope, 9) AS slope, round(median(x0 - slope * t_start), 9) AS intercept, count(*) AS n FROM notes JOIN s USING (song_id) GROUP BY song_id, slope""")
def sweep_lines_by_join(spark, sf_dir):
    """The same lines with a self-join of each song's few notes."""
    d = R.theil_sen_pairs(notes(spark, sf_dir), ["song_id"], "t_start", "x0")
    return d.select("song_id", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"), "n")


@query()
def page_lines(spark, sf_dir):
    """Up to two sweeps that four or more notes of a song start on."""
    return R.ransac_lines(notes(spark, sf_dir), ["song_id"], "t_start", "x0", 2.0, (2.0, 1200.0), 20.0)


@query(f"""
WITH {NOTES}, h AS (SELECT song_id, (CAST(x0 AS INT) + o + 180) % 180 AS mode, count(*) AS weight FROM notes, range(-6, 7) r(o) GROUP BY 1, 2)
SELECT song_id, CAST(mode AS INT) AS mode, weight FROM h QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY weight DESC, mode) = 1""")
def hue_modes(spark, sf_dir):
    """The commonest hue of a song on a circle of 180, thirteen hues at once."""
    return R.circular_mode(notes(spark, sf_dir), ["song_id"], "x0")


@query(f"""
WITH {NOTES}, h AS (SELECT page, cy AS y, count(*) AS m FROM notes GROUP BY 1, 2), n AS (SELECT page, y, m / sum(m) OVER (PARTITION BY page) AS n FROM h), g AS (SELECT 6.5::DOUBLE + i * 0.02::DOUBLE AS a FROM range(325) r(i)),
c AS (SELECT page, a, sum(n * cos(2 * pi() * y / a)) AS c, sum(n * sin(2 * pi() * y / a)) AS s FROM n, g GROUP BY 1, 2),
f AS (SELECT *, atan2(s, c) / (2 * pi()) AS turn FROM c), q AS (SELECT *, (turn - floor(turn)) * a AS phase FROM f),
r AS (SELECT page, a, phase, any_value(0.25::DOUBLE * sqrt(c * c + s * s)) + sum(CASE WHEN abs((y - phase + a / 2) - a * floor((y - phase + a / 2) / a) - a / 2) < 1.6 THEN n ELSE 0 END) AS score FROM q JOIN n USING (page) GROUP BY 1, 2, 3)
SELECT page, round(a, 6) AS spacing, round(phase, 6) % round(a, 6) AS phase, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY round(score, 9) DESC, a) = 1""")
def row_lattices(spark, sf_dir):
    """Row spacing and phase (on its circle: a whole spacing is none) of every page number's bars."""
    d = R.lattice_fit(notes(spark, sf_dir), ["page"], "cy")
    return d.select("page", F.round("spacing", 6).alias("spacing"), F.pmod(F.round("phase", 6), F.round("spacing", 6)).alias("phase"), F.round("score", 6).alias("score"))


@query(f"""
WITH {NOTES} SELECT song_id, pos, round(abs((((cy - 3.0 + 3.75) % 7.5) + 7.5) % 7.5 - 3.75), 6) AS rest, CAST(-round_even((cy - 3.0) / 7.5, 0) AS INT) AS k FROM notes WHERE abs((((cy - 3.0 + 3.75) % 7.5) + 7.5) % 7.5 - 3.75) <= 3.2""")
def lattice_rows(spark, sf_dir):
    """Bars near a row of a known lattice, with the row."""
    rest = R.lattice_rest(F.col("cy"), 7.5, 3.0)
    return notes(spark, sf_dir).where(rest <= 3.2).select("song_id", "pos", F.round(rest, 6).alias("rest"), R.lattice_row(F.col("cy"), 7.5, 3.0).alias("k"))


@query(f"""
WITH {NOTES}, m AS (SELECT page, median(x1 - x0) AS m FROM notes GROUP BY 1) SELECT song_id, pos FROM notes JOIN m USING (page) WHERE abs(x1 - x0 - m) <= 5""")
def near_median_width(spark, sf_dir):
    """Bars whose width is near the median of their page number."""
    return R.near_median(notes(spark, sf_dir).withColumn("w", F.col("x1") - F.col("x0")), ["page"], "w", 5.0).select("song_id", "pos")


@query("""
WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT user_id, round(any_value(m) + greatest(6 * median(abs(value - m)), 0.8), 6) AS threshold FROM events JOIN m USING (user_id) GROUP BY 1""")
def event_thresholds(spark, sf_dir):
    """Each user's threshold: median plus six median deviations."""
    return R.mad_threshold(table(spark, sf_dir, "events"), ["user_id"], "value").select("user_id", F.round("threshold", 6).alias("threshold"))


@query(f"""
WITH {NOTES} SELECT page, round(quantile_cont(x0, 0.05), 3) AS p05, round(quantile_cont(x0, 0.5), 3) AS p50, round(quantile_cont(x0, 0.9), 3) AS p90, round(avg(CASE WHEN x0 < 100 THEN 1.0 ELSE 0.0 END), 6) AS below FROM notes GROUP BY 1""")
def place_percentiles(spark, sf_dir):
    """Percentiles of the places by page number, and the share below 100."""
    n = notes(spark, sf_dir)
    below = n.groupBy("page").agg(F.round(F.avg((F.col("x0") < 100).cast("double")), 6).alias("below"))
    q = quantiles(n, ["page"], "x0", {"p05": 0.05, "p50": 0.5, "p90": 0.9})
    return q.select("page", *[F.round(c, 3).alias(c) for c in ("p05", "p50", "p90")]).join(below, "page")


@query(f"""
WITH {NOTES}, x AS (SELECT *, midi // 4 AS k, CASE WHEN midi >= 70 THEN 'high' WHEN midi < 50 THEN 'low' ELSE 'main' END AS cls FROM notes), c AS (SELECT page, cls, k, count(*) AS n FROM x GROUP BY 1, 2, 3),
m AS (SELECT page, cls, k AS mode FROM c QUALIFY row_number() OVER (PARTITION BY page, cls ORDER BY n DESC, k) = 1)
SELECT song_id, pos, abs(k - mode) <= 1 AS consistent FROM x JOIN m USING (page, cls) WHERE cls <> 'main'""")
def consistent_extremes(spark, sf_dir):
    """Whether high and low notes lie near the commonest row of their class."""
    cls = F.when(F.col("midi") >= 70, "high").when(F.col("midi") < 50, "low").otherwise("main")
    d = notes(spark, sf_dir).withColumn("k", F.expr("midi div 4")).withColumn("cls", cls).where("cls <> 'main'")
    return R.extremes_consistent(d, ["page"], "cls", "k").select("song_id", "pos", "consistent")


@query(f"""
WITH {NOTES}, h AS (SELECT song_id, midi % 12 AS pc, count(*) AS n FROM notes GROUP BY 1, 2), s AS (SELECT song_id, base, sum(CASE WHEN (pc + base) % 12 IN (0, 2, 4, 5, 7, 9, 11) THEN n ELSE 0 END) AS score FROM h, range(0, 12) r(base) GROUP BY 1, 2),
k AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY song_id ORDER BY score DESC, base))
SELECT song_id, CAST(base AS INT) AS base, score::BIGINT AS score, (score - second)::BIGINT AS margin FROM k WHERE rn = 1""")
def song_keys(spark, sf_dir):
    """The key in which most of a song's notes are of the scale, and its margin over the next."""
    pc = F.col("midi") % 12
    d = notes(spark, sf_dir).groupBy("song_id").agg(*[F.count_if(((pc + b) % 12).isin(0, 2, 4, 5, 7, 9, 11)).alias(f"_{b}") for b in range(12)])
    # a row for each song, its twelve scores in it: the best first, of equal ones the least base
    best = F.sort_array(F.array(*[F.struct((-F.col(f"_{b}")).alias("less"), F.lit(b).alias("base")) for b in range(12)]))
    d = d.select("song_id", F.get(best, F.lit(0)).alias("a"), F.get(best, F.lit(1)).alias("b"))
    return d.select("song_id", F.col("a.base").alias("base"), (-F.col("a.less")).alias("score"), (F.col("b.less") - F.col("a.less")).alias("margin"))


@query(f"""
WITH {NOTES}, m AS (SELECT song_id, page, sum(CASE WHEN pos % 3 <> 0 THEN 1 ELSE 0 END)::BIGINT AS mapped, count(*) AS detected, sum(CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS missed FROM notes WHERE song_id < 2000 OR song_id >= 2000 GROUP BY ROLLUP (song_id, page))
SELECT * FROM m""")
def page_report(spark, sf_dir):
    """Mapped, detected and missed bars of every page, every song and overall."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return notes(spark, sf_dir).rollup("song_id", "page").agg(n(F.col("pos") % 3 != 0).alias("mapped"), F.count("*").alias("detected"), n(F.col("pos") % 3 == 0).alias("missed"))


CONTAINED = "SELECT * FROM notes QUALIFY coalesce(max(t_end) OVER (PARTITION BY song_id, {pitch} ORDER BY t_start, t_end, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < t_end - 0.02, true)"


@query(f"""
WITH {NOTES}, d AS ({CONTAINED.format(pitch="midi")}), cut AS (SELECT DISTINCT song_id, unnest([t_start, t_end]) AS s FROM d), seg AS (SELECT * FROM (SELECT song_id, s, lead(s) OVER (PARTITION BY song_id ORDER BY s) AS e FROM cut) WHERE e - s >= 0.02),
own AS (SELECT g.song_id, s, e, pos FROM seg g JOIN d n ON n.song_id = g.song_id AND n.t_start <= s AND n.t_end >= e QUALIFY row_number() OVER (PARTITION BY g.song_id, s ORDER BY t_start DESC, t_end, pos) = 1),
r AS (SELECT *, sum(new) OVER (PARTITION BY song_id ORDER BY s) AS island FROM (SELECT *, CASE WHEN pos = lag(pos) OVER w AND s - lag(e) OVER w <= 0.035001 THEN 0 ELSE 1 END AS new FROM own WINDOW w AS (PARTITION BY song_id ORDER BY s)))
SELECT song_id, pos, min(s) AS t_start, max(e) AS t_end FROM r GROUP BY song_id, pos, island HAVING max(e) - min(s) >= 0.035""")
def monophonic_notes(spark, sf_dir):
    """Notes without contained duplicates of one pitch, cut so that no two sound together: the one that started last wins."""
    return I.last_wins(I.drop_contained(notes(spark, sf_dir), ["song_id"], "pos", "midi", "t_start", "t_end"), ["song_id"], "pos")


@query(f"""
WITH {NOTES} SELECT song_id, page, midi, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS n_merged FROM notes GROUP BY 1, 2, 3""")
def merged_splits(spark, sf_dir):
    """Pieces of one note joined by their exact key."""
    return I.undo_splits(notes(spark, sf_dir), ["song_id"], ["page", "midi"], "t_start", "t_end")


@query(f"WITH {NOTES} SELECT song_id, midi % 4 AS pc, pos FROM ({CONTAINED.format(pitch='midi % 4')})")
def uncontained_notes(spark, sf_dir):
    """Notes that no earlier note of their pitch class contains."""
    d = notes(spark, sf_dir).withColumn("pc", F.col("midi") % 4)
    return I.drop_contained(d, ["song_id"], "pos", "pc", "t_start", "t_end").select("song_id", "pc", "pos")


@query()
def preferred_bars(spark, sf_dir):
    """Bars of a row of a page that overlap none of greater preference: those seen three times or more first, the narrower
    first; then the others, the more often seen first."""
    seen, width = F.col("pos") % 5, F.col("x1") - F.col("x0")
    d = notes(spark, sf_dir).withColumns({"k": R.lattice_row(F.col("cy"), 40.0, 0.0), "rare": (seen < 3).cast("int"), "second": F.when(seen >= 3, width).otherwise(-seen.cast("double"))})
    return I.suppress_overlaps(d, ["song_id", "page", "k"], "pos", [("rare", False), ("second", False)], "x0", "x1")


@query()
def bar_clusters(spark, sf_dir):
    """Bars of a song's page that lie together."""
    return I.cluster_bars(notes(spark, sf_dir), ["song_id", "page"], ["t_start", "pos"])


@query()
def bar_tracks(spark, sf_dir):
    """Detections of a song joined into tracks over frames."""
    return I.track(notes(spark, sf_dir).withColumn("frame", F.col("t_start").cast("long")), ["song_id"], "frame")


@query()
def drawn_tracks(spark, sf_dir):
    """Detections of a song's page joined into the bars that they draw."""
    d = notes(spark, sf_dir).select("song_id", "page", F.col("t_start").cast("long").alias("frame"), F.floor(F.col("x0") / 60).alias("x0"), "x1", "cy", F.lit(9.0).alias("h"))
    return I.grow_tracks(d, ["song_id", "page"], "frame", 5, 40.0, 7.0, 100.0)


def at_pace(n):
    """Notes whose places follow their times at 75 pixels a second, a third of them up to 240 pixels off."""
    x0 = F.col("t_start") * 75 + F.when(F.col("pos") % 3 == 0, F.col("x0") % 240).otherwise(F.col("x0") % 12)
    return n.withColumn("width", F.col("x1") - F.col("x0")).withColumn("x0", x0).withColumn("x1", F.col("x0") + F.col("width")).drop("width")


@query()
def deduped_notes(spark, sf_dir):
    """What becomes of colliding notes of each sweep: the audit log's reasons and the notes kept."""
    n = at_pace(notes(spark, sf_dir)).withColumn("pitch", F.col("midi") % 4)
    d = confirmed_sweeps(n, ["song_id"], "pos", 300.0, ["x0", "x1", "t_start", "t_end", "pitch", "page"])
    return dedupe_sweep(d, ["song_id"], "sweep", "pos", "pitch", F.col("page"), dealt=True)
