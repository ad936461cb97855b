"""Queries of the scorer: frames are the events of a user a quarter of a second apart, the song is the order of that number."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import scoring as S
from cadenza.operators.sequence import by
from cadenza.plans.registry import query
from cadenza.plans.views import NOTES, notes, table

FRAMES = """frames AS (SELECT user_id AS session_id, user_id AS song_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 0.25::DOUBLE AS t,
  CASE WHEN CAST(props->>'k' AS INT) % 11 <> 0 THEN 36 + CAST(props->>'k' AS INT) % 49 + (CAST(props->>'k' AS INT) % 8) * 0.125::DOUBLE END AS midi FROM events)"""
CREDIT = f"""{NOTES}, {FRAMES}, f AS (SELECT *, t - lag(t) OVER (PARTITION BY session_id ORDER BY t) AS dt FROM frames), g AS (SELECT * FROM f WHERE dt > 0 AND dt < 0.3),
a AS (SELECT g.*, n.pos, n.midi AS note_midi FROM g LEFT JOIN notes n ON n.song_id = g.song_id AND t BETWEEN t_start AND t_end QUALIFY row_number() OVER (PARTITION BY session_id, t ORDER BY t_start DESC, pos DESC) = 1),
c AS (SELECT *, midi + 12 * floor((note_midi - midi) / 12 + 0.5) - note_midi AS off FROM a),
k AS (SELECT *, CASE WHEN abs(off) <= 0.75 THEN 1.0::DOUBLE WHEN abs(off) <= 1.6 THEN (1.6::DOUBLE - abs(off)) / (1.6::DOUBLE - 0.75::DOUBLE) WHEN off IS NOT NULL THEN 0.0::DOUBLE END AS credit FROM c)"""
RESULTS = f"""{CREDIT}, o AS (SELECT session_id, pos, sum(dt * credit) AS hit, sum(CASE WHEN abs(off) <= 1.6 THEN off * 100 * dt END) AS c, sum(CASE WHEN abs(off) <= 1.6 THEN dt END) AS w FROM k WHERE off IS NOT NULL GROUP BY 1, 2),
z AS (SELECT s.session_id, n.*, (SELECT min(t) FROM g WHERE g.session_id = s.session_id AND g.t > n.t_end) AS closed_at FROM (SELECT DISTINCT session_id, song_id FROM g) s JOIN notes n USING (song_id)),
y AS (SELECT z.*, coalesce(hit, 0.0) AS hit, c / w AS cents, closed_at - t_end > 1.5 AS late FROM z LEFT JOIN o USING (session_id, pos) WHERE closed_at IS NOT NULL),
x AS (SELECT *, CASE WHEN late THEN 0.0 ELSE least(1.0, hit / (t_end - t_start)) END AS acc FROM y),
r AS (SELECT *, CASE WHEN late THEN NULL WHEN acc >= 0.82 THEN 3 WHEN acc >= 0.55 THEN 2 WHEN acc >= 0.28 THEN 1 ELSE 0 END AS rating FROM x)"""


def frames(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("user_id").alias("song_id"), (F.row_number().over(by(["user_id"], ["ts", "event_id"])) * 0.25).alias("t"),
        F.when(k % 11 != 0, 36 + k % 49 + (k % 8) * 0.125).alias("midi"))


def scored(spark, sf_dir):
    """Frames and the notes of their songs."""
    f = frames(spark, sf_dir)
    return f, notes(spark, sf_dir, f)


@query(f"WITH {CREDIT} SELECT session_id, t, pos, round(credit, 6) AS credit FROM k")
def frame_credits(spark, sf_dir):
    """The note that sounds at every frame, and what the frame earns."""
    d = S.frame_credits(*scored(spark, sf_dir))
    return d.select("session_id", "t", "pos", F.round("credit", 6).alias("credit"))


@query(f"WITH {RESULTS} SELECT session_id, pos, CAST(rating AS INT) AS rating, round(acc, 6) AS acc, round(cents, 4) AS cents, closed_at FROM r")
def note_results(spark, sf_dir):
    """Accuracy, rating and cents of every note that was passed."""
    d = S.note_results(*scored(spark, sf_dir))
    return d.select("session_id", "pos", "rating", F.round("acc", 6).alias("acc"), F.round("cents", 4).alias("cents"), "closed_at")


@query(f"""WITH {RESULTS}, u AS (SELECT *, sum(CASE WHEN rating = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY closed_at, t_start, pos) AS miss FROM r),
m AS (SELECT session_id, max(c)::BIGINT AS max_combo FROM (SELECT session_id, sum(CASE WHEN rating > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, miss ORDER BY closed_at, t_start, pos) AS c FROM u) GROUP BY 1),
q AS (SELECT session_id, sum(CASE WHEN rating IS NOT NULL THEN least(hit, t_end - t_start) END) AS h, sum(CASE WHEN rating IS NOT NULL THEN t_end - t_start END) AS d, count_if(rating = 3)::BIGINT AS n_perfect, count_if(rating = 2)::BIGINT AS n_great, count_if(rating = 1)::BIGINT AS n_good, count_if(rating = 0)::BIGINT AS n_miss FROM r GROUP BY 1)
SELECT session_id, n_perfect, n_great, n_good, n_miss, max_combo, round(CASE WHEN d >= 0.5 THEN 100 * pow(h / d, 0.7) END, 4) AS score FROM q JOIN m USING (session_id)""")
def session_scores(spark, sf_dir):
    """Score, ratings and longest combo of every session."""
    return S.session_scores(S.note_results(*scored(spark, sf_dir))).withColumn("score", F.round("score", 4))


@query(f"""WITH {RESULTS}, p AS (SELECT song_id, page AS section, min(t_start) AS t0, min(t_start) + 8 AS t1 FROM notes GROUP BY 1, 2),
s AS (SELECT session_id, section, avg(acc) AS acc FROM r JOIN p USING (song_id) WHERE rating IS NOT NULL AND t_end > t0 AND t_end <= t1 + 0.2 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT session_id, section, round(acc, 6) AS acc, CASE WHEN acc >= 0.8 THEN 'すごい!!' WHEN acc >= 0.55 THEN 'いいね!' WHEN acc >= 0.3 THEN 'おしい…' ELSE 'がんばれ!' END AS stamp FROM s""")
def section_stamps(spark, sf_dir):
    """The stamp of every section with two attempted notes."""
    f, n = scored(spark, sf_dir)
    flips = n.groupBy("song_id", F.col("page").alias("section")).agg(F.min("t_start").alias("t0"), (F.min("t_start") + 8).alias("t1"))
    return S.section_stamps(S.note_results(f, n), flips).withColumn("acc", F.round("acc", 6))
