"""The driver's tables seen as plays, users and songs.

plays: events (event_id, user_id, event_type as song_id, value as score, ts as played_at; completed unless an error).
users: customer. songs: the distinct event types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("song_id"), F.col("value").alias("score"),
        F.col("ts").alias("played_at"), (F.col("event_type") != "error").cast("int").alias("completed"), "props",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("display_name"), F.col("c_nationkey").alias("avatar_ver"),
    )


PLAYS = "plays AS (SELECT event_id AS id, user_id, event_type AS song_id, value AS score, ts AS played_at, CAST(event_type <> 'error' AS INT) AS completed, props FROM events)"
USERS = "users AS (SELECT c_custkey AS user_id, c_name AS display_name, c_nationkey AS avatar_ver FROM customer)"


def notes(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The notes of songs (orders): lineitem with a position of its own, as (l_orderkey, l_linenumber) isn't unique. With
    `of`, whole songs that have its song_ids alone: the others go before positions are given."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem")
    if of is not None:
        lines = lines.join(of.select(F.col("song_id").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
    # numbered before anything is computed: the shuffle has the table's own columns alone, and the songs stay where it put them
    return lines.withColumn("pos", F.row_number().over(w) - 1).select(
        F.col("l_orderkey").alias("song_id"), "pos", F.col("l_quantity").alias("t_start"),
        (F.col("l_quantity") + (F.col("l_partkey") % 8 + 1) * 0.5).alias("t_end"), (F.lit(40) + F.col("l_suppkey") % 40).alias("midi"),
        F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 600).cast("double").alias("x0"),
        (F.col("l_partkey") % 600 + 10 + F.col("l_suppkey") % 50).cast("double").alias("x1"), (F.col("l_partkey") % 23 * 7.5).alias("cy"))


NOTES = """notes AS (SELECT l_orderkey AS song_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS INT) AS pos,
  l_quantity AS t_start, l_quantity + (l_partkey % 8 + 1) * 0.5 AS t_end, 40 + l_suppkey % 40 AS midi, l_linenumber AS page, CAST(l_partkey % 600 AS DOUBLE) AS x0,
  CAST(l_partkey % 600 + 10 + l_suppkey % 50 AS DOUBLE) AS x1, l_partkey % 23 * 7.5::DOUBLE AS cy FROM lineitem)"""
