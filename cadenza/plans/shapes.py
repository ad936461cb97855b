"""Queries of profiles and templates: the embeddings are profiles of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import profiles as P, templates as T
from cadenza.plans.registry import query
from cadenza.plans.views import table

ELEMENTS = "e AS (SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


@query(f"""
WITH {ELEMENTS}, r AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM e WHERE x >= 0.1),
s AS (SELECT vec_id, min(i) AS a, max(i) AS b FROM r GROUP BY vec_id, g)
SELECT s.vec_id, CAST((a + b) // 2 AS INT) AS x, CAST(b - a + 1 AS INT) AS width FROM s JOIN e l ON l.vec_id = s.vec_id AND l.i = greatest(0, a - 2) JOIN e h ON h.vec_id = s.vec_id AND h.i = least(63, b + 2)
WHERE b - a + 1 <= 3 AND a >= 3 AND l.x <= 0.05 AND h.x <= 0.05""")
def profile_peaks(spark, sf_dir):
    """Narrow isolated peaks of every vector."""
    p = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.inline(P.isolated_peaks(p, 0.1, 0.05, widest=3, beyond=2)))


@query(f"""
WITH {ELEMENTS}, m AS (SELECT vec_id, i, CASE WHEN x > -0.1 THEN floor(x * 40) END AS c FROM e),
s AS (SELECT *, CASE WHEN lag(c) OVER w IS NULL OR abs(c - lag(c) OVER w) > 6 THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM s WHERE c IS NOT NULL)
SELECT vec_id, min(i) AS x0, CAST(max(i) + 1 AS INT) AS x1, round(avg(c), 6) AS middle FROM g GROUP BY vec_id, g HAVING count(*) >= 3""")
def profile_bars(spark, sf_dir):
    """Every vector cut into bars where its middles jump."""
    middles = F.transform("embedding", lambda x: F.when(x.cast("double") > -0.1, F.floor(x.cast("double") * 40).cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.inline(P.split_bars(middles, 6.0))).withColumn("middle", F.round("middle", 6))


def matches(spark, sf_dir):
    """Every vector with the label whose first vector's middle correlates best with a stretch of it."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    templates = first.select(F.col("label").cast("string").alias("label"), F.slice("v", 17, 32).alias("values"))
    return T.matched(e.select("vec_id", F.col("label").alias("song_id"), "embedding"), "embedding", templates)


MATCHES = """n AS (SELECT vec_id, label AS song_id, place, list_transform(w, lambda x: x - list_avg(w)) AS w FROM (SELECT vec_id, label, CAST(place AS INT) AS place, CAST(embedding[place + 1:place + 32] AS DOUBLE[]) AS w FROM embeddings, range(0, 33) r(place))),
t AS (SELECT label, list_transform(w, lambda x: x - list_avg(w)) AS w FROM (SELECT CAST(label AS VARCHAR) AS label, CAST(arg_min(embedding, vec_id)[17:48] AS DOUBLE[]) AS w FROM embeddings GROUP BY label)),
c AS (SELECT vec_id, song_id, t.label, place, list_inner_product(n.w, t.w) / sqrt(list_inner_product(n.w, n.w) * list_inner_product(t.w, t.w)) AS score FROM n, t),
b AS (SELECT vec_id, song_id, label, max(score) AS score, arg_max(place, score) AS place FROM c GROUP BY 1, 2, 3),
matches AS (SELECT *, score - lead(score) OVER w AS margin, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, label))"""


@query(f"WITH {MATCHES} SELECT vec_id, label, place, round(score, 6) AS score, round(margin, 6) AS margin FROM matches WHERE rn = 1")
def matched_templates(spark, sf_dir):
    """The template of every vector, where it lies, and its lead."""
    return matches(spark, sf_dir).select("vec_id", "label", F.col("at").alias("place"), F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(f"""
WITH {MATCHES}, v AS (SELECT song_id, (CAST(label AS INT) - vec_id % 12 + 12) % 12 AS choice, sum(score) AS votes FROM matches WHERE rn = 1 GROUP BY 1, 2)
SELECT song_id, CAST(choice AS INT) AS choice, round(votes, 6) AS votes, round(margin, 6) AS margin FROM (SELECT *, votes - lead(votes) OVER w AS margin, row_number() OVER w AS rn FROM v WINDOW w AS (PARTITION BY song_id ORDER BY votes DESC, choice)) WHERE rn = 1""")
def voted_offsets(spark, sf_dir):
    """The offset of every song's rows for which its matched labels vote, by their scores."""
    offset = F.pmod(F.col("label").cast("int") - F.col("vec_id") % 12, F.lit(12)).cast("int")
    d = T.voted(matches(spark, sf_dir), ["song_id"], offset, F.col("score"))
    return d.select("song_id", "choice", F.round("votes", 6).alias("votes"), F.round("margin", 6).alias("margin"))
