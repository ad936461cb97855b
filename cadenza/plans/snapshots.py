"""Queries of the snapshot transforms: ingest, merge, backfill, deletion, gates and audit counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators.relational import backfill, delete_cascade, merge
from cadenza.plans.registry import query
from cadenza.plans.views import PLAYS, plays, table
from cadenza.sources import ingest


def submitted(spark, sf_dir):
    return plays(spark, sf_dir).withColumns({"max_combo": F.when(F.col("id") % 97 == 0, -1).otherwise(F.col("id") % 50), "n_perfect": F.when(F.col("id") % 3 == 0, "x").otherwise((F.col("id") % 7 - 2).cast("string"))})


@query(f"""WITH {PLAYS} SELECT id, round(score, 3) AS score, CASE WHEN id % 3 = 0 THEN 0 ELSE greatest(0, id % 7 - 2)::INT END AS n_perfect FROM plays WHERE score <= 100 AND id % 97 <> 0""")
def accepted_plays(spark, sf_dir):
    """Plays that pass the checks, as they are stored."""
    return ingest.accepted(submitted(spark, sf_dir)).select("id", "score", "n_perfect")


@query(f"""WITH {PLAYS} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN score > 100 THEN 'score out of bounds' WHEN id % 97 = 0 THEN 'negative combo' END AS reason FROM plays) WHERE reason IS NOT NULL GROUP BY 1""")
def rejected_plays(spark, sf_dir):
    """How many plays each check sets aside."""
    return ingest.rejected(submitted(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT id, song_id, CAST(pos AS INT) AS pos, rating, acc, cents FROM (SELECT event_id AS id, event_type AS song_id, unnest([0, 2]) AS pos, unnest([3, NULL]) AS rating, unnest([value, 0.0::DOUBLE]) AS acc, unnest([12.0::DOUBLE, NULL]) AS cents FROM events WHERE event_id % 5 <> 0)""")
def parsed_results(spark, sf_dir):
    """Notes out of the JSON of plays: short rows are left out, what isn't JSON has none."""
    text = F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.concat(F.lit('{"notes":[[3,'), F.col("value").cast("string"), F.lit(",12],[1],[null,0,null]]}")))
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("song_id"), text.alias("results"))
    return ingest.note_results(d)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS duration, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'new' WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS title FROM customer
UNION ALL SELECT c_custkey + 1000000, c_acctbal + 1, 'new' FROM customer WHERE c_custkey % 2 = 0""")
def merged_songs(spark, sf_dir):
    """An import merged into a table: durations overwrite, titles only fill in, unknown songs are added."""
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("duration"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("title"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("duration"), F.lit("new").alias("title"))
    new = new.select(F.explode(F.array("c_custkey", F.col("c_custkey") + 1_000_000)).alias("id"), "duration", "title")
    return merge(old, new, "id", ["duration"], ["title"])


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END, c.c_custkey) AS owner FROM orders o LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) c ON o.o_custkey % 5 = 0 AND c.c_nationkey = o.o_orderkey % 30""")
def backfilled_owners(spark, sf_dir):
    """Orders without an owner given the first who claimed their seat."""
    owner = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", owner.alias("owner"), (F.col("o_orderkey") % 30).cast("int").alias("seat"))
    claims = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("seat"), "c_custkey")
    return backfill(o, "owner", claims, ["seat"], "c_custkey").select("o_orderkey", "owner")


@query("""SELECT 'parent' AS kept, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'notes', count(*) FROM lineitem WHERE l_orderkey % 7 <> 0""")
def cascaded_delete(spark, sf_dir):
    """Deleting orders takes their line items along."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kept = delete_cascade(o, "o_orderkey", o.where("o_orderkey % 7 = 0").select("o_orderkey"), {"notes": (l, "l_orderkey")})
    n = lambda name: kept[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n")
    return n("parent").unionByName(n("notes"))


@query("""SELECT CASE WHEN w < 7 THEN 'tiny' WHEN life < 2 THEN 'tiny' WHEN grew < 3 AND w > 26 THEN 'static' WHEN rate < 0.55 THEN 'flicker' WHEN h < 8 THEN 'thin' WHEN life < 6 AND grew < 3 THEN 'remnant' END AS reason, count(*) AS n
FROM (SELECT l_partkey % 60 AS w, l_suppkey % 30 AS life, l_partkey % 60 - l_linenumber * 8 AS grew, l_quantity / (l_suppkey % 30 + 1) AS rate, l_quantity AS h FROM lineitem) GROUP BY 1""")
def track_reasons(spark, sf_dir):
    """How many tracks each rule rejects (null: kept): the audit log's counts."""
    d = table(spark, sf_dir, "lineitem").select(
        F.lit(0).alias("x0"), (F.col("l_partkey") % 60).alias("x1"), F.lit(0).alias("first_f"), (F.col("l_suppkey") % 30).alias("last_f"),
        (F.col("l_linenumber") * 8).alias("first_w"), F.col("l_quantity").alias("hits"), F.col("l_quantity").alias("h"))
    return d.withColumn("reason", ingest.track_reason()).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT l_returnflag AS skin, l_partkey % 60 AS w, l_suppkey % 30 AS life, l_partkey % 60 - l_linenumber * 8 AS grew, l_quantity / (l_suppkey % 30 + 1) AS rate, l_quantity AS h FROM lineitem),
m AS (SELECT skin, greatest(8.0::DOUBLE, 0.6::DOUBLE * median(CASE WHEN w >= 7 THEN h END)) AS thin FROM d GROUP BY 1)
SELECT skin, CASE WHEN w < 7 THEN 'tiny' WHEN life < 2 THEN 'tiny' WHEN grew < 3 AND w > 26 THEN 'static' WHEN rate < 0.55 THEN 'flicker' WHEN h < thin THEN 'thin' WHEN life < 6 AND grew < 3 THEN 'remnant' END AS reason, count(*) AS n FROM d JOIN m USING (skin) GROUP BY 1, 2""")
def adaptive_track_reasons(spark, sf_dir):
    """How many tracks each rule rejects where the least height follows from a skin's own bars."""
    d = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("skin"), F.lit(0).alias("x0"), (F.col("l_partkey") % 60).alias("x1"), F.lit(0).alias("first_f"), (F.col("l_suppkey") % 30).alias("last_f"),
        (F.col("l_linenumber") * 8).alias("first_w"), F.col("l_quantity").alias("hits"), F.col("l_quantity").alias("h"))
    return ingest.with_thin(d, ["skin"]).withColumn("reason", ingest.track_reason(thin=F.col("thin"))).groupBy("skin", "reason").agg(F.count("*").alias("n"))
