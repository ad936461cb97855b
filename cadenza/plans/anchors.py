"""Queries of anchoring, exact percentiles and bisection."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cadenza.operators import anchoring as A, selection as X
from cadenza.plans.registry import query
from cadenza.plans.views import NOTES, notes, table

LOW, SIZE, STEP = 30, 64, 1.0


def sound(spark, sf_dir):
    """The vectors of a label, in order, as frames of a song's sound."""
    w = W.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("song_id"), (F.row_number().over(w) - 1).alias("frame"), F.transform("embedding", F.abs).alias("energy"))


def sung(spark, sf_dir):
    """The notes of ten songs, each of all notes of a tenth of the orders, in rows."""
    n = notes(spark, sf_dir).withColumn("order_id", F.col("song_id"))
    return n.select((F.col("order_id") % 10).alias("song_id"), (F.col("order_id") * 100 + F.col("pos")).alias("pos"), ((F.col("t_start") - 1) * 0.9).alias("t_start"), ((F.col("t_start") - 1) * 0.9 + F.col("t_end") - F.col("t_start")).alias("t_end"), (F.col("midi") - 60).cast("int").alias("k"))


ANCHORS = f"""{NOTES}, sung AS (SELECT song_id % 10 AS song_id, song_id * 100 + pos AS pos, (t_start - 1) * 0.9::DOUBLE AS t_start, (t_start - 1) * 0.9::DOUBLE + t_end - t_start AS t_end, midi - 60 AS k FROM notes),
e AS (SELECT label AS song_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: ln(1 + CAST(abs(x) AS DOUBLE))) AS v FROM embeddings),
w AS (SELECT song_id, frame, list_transform(v, lambda x: x / greatest(list_sum(v) / {SIZE}, 1e-6)) AS v FROM e),
s AS (SELECT *, CAST(floor((t_start + 0.15::DOUBLE * (t_end - t_start)) / {STEP}::DOUBLE) AS BIGINT) AS a FROM sung),
r AS (SELECT *, greatest(a + 1, CAST(floor((t_end - 0.15::DOUBLE * (t_end - t_start)) / {STEP}::DOUBLE) AS BIGINT)) AS b FROM s),
m AS (SELECT r.*, min(CASE WHEN b > frames THEN pos END) OVER (PARTITION BY r.song_id) AS first FROM r JOIN (SELECT song_id, max(frame) + 1 AS frames FROM e GROUP BY 1) USING (song_id)),
l AS (SELECT song_id, pos, k, unnest(range(a, b)) AS frame FROM m WHERE first IS NULL OR pos < first)"""


@query(f"""
WITH {ANCHORS}, c AS (SELECT song_id, pos, k, frame, v, count(*) OVER (PARTITION BY song_id, pos) AS n FROM l JOIN w USING (song_id, frame)),
span AS (SELECT song_id, min(k) AS lo, max(k) AS hi, median(k) AS mid FROM sung GROUP BY 1),
bases AS (SELECT song_id, CAST(base AS INT) AS base FROM span, range({LOW}, {LOW + SIZE}) t(base) WHERE base + lo >= {LOW} AND base + hi < {LOW + SIZE} AND base + mid BETWEEN 53 AND 76),
sc AS (SELECT song_id, base, sum((v[base + k - {LOW} + 1] + 0.35::DOUBLE * coalesce(v[base + k - {LOW} + 13], 0)) / n) / count(DISTINCT pos) AS score FROM c JOIN bases USING (song_id) GROUP BY 1, 2)
SELECT song_id, base, round(score, 6) AS score, round(margin, 6) AS margin FROM (SELECT *, score - lead(score) OVER x AS margin, row_number() OVER x AS rn FROM sc WINDOW x AS (PARTITION BY song_id ORDER BY score DESC, base)) WHERE rn = 1""")
def anchored_songs(spark, sf_dir):
    """Base, score and margin of every song by the energies of its sound."""
    d = A.anchored(sound(spark, sf_dir), sung(spark, sf_dir), "song_id", "pos", "k", STEP, LOW, SIZE)
    return d.select("song_id", "base", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query("""
SELECT l_linenumber % 2 AS half, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY 1""")
def price_percentiles(spark, sf_dir):
    """Exact percentiles of two groups that hold half of all rows each, no group in one task."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2).alias("half"), "l_extendedprice")
    q = X.quantiles(d, ["half"], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p999": 0.999}, large=1000)
    return q.select("half", *[F.round(c, 6).alias(c) for c in ("p01", "p50", "p999")])


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT o_custkey AS user_id, y::INT AS year, min(CASE WHEN o_orderdate >= make_date(y::INT, 1, 1) THEN place END) AS flip FROM f, (SELECT unnest(range(1993, 1998)) AS y) GROUP BY 1, 2""")
def bisected_flips(spark, sf_dir):
    """The place of every customer's first order of a year or later, by bisection of their orders."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.row_number().over(w).cast("long").alias("place"), "o_orderdate")
    r = f.groupBy("user_id").agg(F.max("place").alias("high")).select("user_id", "high", F.lit(0).alias("low"), F.explode(F.sequence(F.lit(1993), F.lit(1997))).alias("year"))
    d = X.bisected(r, f.withColumn("of", F.year("o_orderdate")).drop("o_orderdate"), ["user_id"], "place", "low", "high", F.col("of") >= F.col("_r.year"))
    return d.select("user_id", "year", "flip")
