"""Leaderboards, bests, ranks and feeds."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cadenza.operators.relational import argmax_first, clamp, first_by, last_n, ranked, search, top_ranked
from cadenza.plans.registry import query
from cadenza.plans.views import PLAYS, USERS, plays, table, users

DONE = "completed = 1 AND user_id IS NOT NULL"


@query(f"""
WITH {PLAYS}, {USERS},
best AS (SELECT user_id, song_id, max(score) AS best FROM plays WHERE {DONE} GROUP BY 1, 2),
n AS (SELECT user_id, count(*) AS n_plays FROM plays WHERE {DONE} GROUP BY 1),
b AS (SELECT user_id, avg(best) AS mean_best, count(*) AS n_songs, max(best) AS top FROM best GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY round(mean_best, 6) DESC, user_id) AS INT) AS rank, user_id, display_name, round(mean_best, 6) AS mean_best, n_songs, top, n_plays
FROM b JOIN users USING (user_id) JOIN n USING (user_id) ORDER BY round(mean_best, 6) DESC, user_id LIMIT 100""")
def overall_leaderboard(spark, sf_dir):
    """Mean of each user's best scores, the first 100 users with their rank."""
    done = plays(spark, sf_dir).where(DONE)
    per_song = done.groupBy("user_id", "song_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    board = per_song.groupBy("user_id").agg(
        F.round(F.avg("best"), 6).alias("mean_best"), F.count("*").alias("n_songs"), F.max("best").alias("top"), F.sum("n").alias("n_plays"))
    board = board.join(users(spark, sf_dir), "user_id")
    return top_ranked(board, 100, F.desc("mean_best"), F.col("user_id")).select("rank", "user_id", "display_name", "mean_best", "n_songs", "top", "n_plays")


@query(f"""
WITH {PLAYS} SELECT song_id, user_id, max(score) AS best, count(*) AS n, max(played_at) AS last_play FROM plays WHERE completed = 1 GROUP BY 1, 2""")
def my_song_aggregates(spark, sf_dir):
    """Best, count and last play of every user on every song."""
    return plays(spark, sf_dir).where("completed = 1").groupBy("song_id", "user_id").agg(
        F.max("score").alias("best"), F.count("*").alias("n"), F.max("played_at").alias("last_play"))


@query(f"""
WITH {PLAYS}, {USERS}, b AS (SELECT song_id, user_id, max(score) AS best, count(*) AS n FROM plays WHERE {DONE} GROUP BY 1, 2)
SELECT song_id, user_id, display_name, avatar_ver, best, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY song_id ORDER BY best DESC, user_id) AS INT) AS rank FROM b) JOIN users USING (user_id) WHERE rank <= 100""")
def song_leaderboards(spark, sf_dir):
    """The first 100 singers of every song."""
    best = plays(spark, sf_dir).where(DONE).groupBy("song_id", "user_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    top = last_n(best, ["song_id"], 100, F.desc("best"), F.col("user_id")).withColumnRenamed("rank_in_group", "rank")
    return top.join(users(spark, sf_dir), "user_id").select("song_id", "user_id", "display_name", "avatar_ver", "best", "n", "rank")


@query(f"""
WITH {PLAYS}, {USERS}, b AS (SELECT song_id, user_id, max(score) AS best FROM plays WHERE {DONE} GROUP BY 1, 2),
s AS (SELECT DISTINCT song_id FROM plays)
SELECT s.song_id, user_id, display_name, best FROM s LEFT JOIN (SELECT b.*, display_name, row_number() OVER (PARTITION BY song_id ORDER BY best DESC, b.user_id) AS rn FROM b JOIN users USING (user_id)) t ON s.song_id = t.song_id AND rn = 1""")
def songs_with_top_singer(spark, sf_dir):
    """Every song with its best singer, if any: one window in place of a lookup per song."""
    p = plays(spark, sf_dir)
    best = p.where(DONE).groupBy("song_id", "user_id").agg(F.max("score").alias("best"))
    top = first_by(best.join(users(spark, sf_dir), "user_id"), ["song_id"], F.desc("best"), F.col("user_id"))
    return p.select("song_id").distinct().join(top, "song_id", "left").select("song_id", "user_id", "display_name", "best")


@query(f"""
WITH {PLAYS}, {USERS} SELECT id, user_id, display_name, song_id, score, played_at FROM plays JOIN users USING (user_id) WHERE completed = 1 ORDER BY played_at DESC, id DESC LIMIT 20""")
def recent_feed(spark, sf_dir):
    """The last 20 finished plays with their singers."""
    p = plays(spark, sf_dir).where("completed = 1").join(users(spark, sf_dir), "user_id")
    return p.select("id", "user_id", "display_name", "song_id", "score", "played_at").orderBy(F.desc("played_at"), F.desc("id")).limit(20)


@query(f"""
WITH {PLAYS}, b AS (SELECT song_id, user_id, max(round(score, 3)) AS best FROM plays WHERE {DONE} GROUP BY 1, 2)
SELECT song_id, user_id, best, rank() OVER (PARTITION BY song_id ORDER BY best DESC) AS rank, count(*) OVER (PARTITION BY song_id) AS n_players FROM b""")
def submit_ranks(spark, sf_dir):
    """The rank that a submitted best has on its song: 1 + players with a better one, rounded against rounded."""
    best = plays(spark, sf_dir).where(DONE).groupBy("song_id", "user_id").agg(F.max(F.round("score", 3)).alias("best"))
    n = best.groupBy("song_id").agg(F.count("*").alias("n_players"))
    return ranked(best, ["song_id"], "best").join(n, "song_id").select("song_id", "user_id", "best", "rank", "n_players")


@query(f"""
WITH {PLAYS}, b AS (SELECT user_id, max(score) AS best FROM plays WHERE {DONE} GROUP BY 1) SELECT user_id, best, CAST(rank() OVER (ORDER BY best DESC) AS BIGINT) AS rank FROM b""")
def global_competition_rank(spark, sf_dir):
    """Rank of every user's best over all songs, without ordering the users in one task."""
    best = plays(spark, sf_dir).where(DONE).groupBy("user_id").agg(F.max("score").alias("best"))
    return ranked(best, [], "best").select("user_id", "best", "rank")


@query(f"""
WITH {PLAYS}, p AS (SELECT *, max(score) OVER (PARTITION BY user_id, song_id ORDER BY played_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM plays WHERE {DONE})
SELECT id, user_id, song_id, score, best_before, coalesce(score > best_before, true) AS is_pb FROM p""")
def personal_bests(spark, sf_dir):
    """Whether each finished play beat all the singer's earlier ones of the song."""
    before = W.partitionBy("user_id", "song_id").orderBy("played_at", "id").rowsBetween(W.unboundedPreceding, -1)
    d = plays(spark, sf_dir).where(DONE).withColumn("best_before", F.max("score").over(before))
    return d.select("id", "user_id", "song_id", "score", "best_before", F.coalesce(F.col("score") > F.col("best_before"), F.lit(True)).alias("is_pb"))


@query(f"""
WITH {PLAYS} SELECT song_id, count(DISTINCT user_id) AS n_players, count(*) AS n_plays, max(score) AS top FROM plays WHERE completed = 1 GROUP BY 1""")
def song_player_counts(spark, sf_dir):
    """Distinct players, plays and top score of every song."""
    return plays(spark, sf_dir).where("completed = 1").groupBy("song_id").agg(F.count_distinct("user_id").alias("n_players"), F.count("*").alias("n_plays"), F.max("score").alias("top"))


@query("""
SELECT max(value) AS best, count(*) AS n, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), 0) AS last_purchase FROM events""")
def global_scalars(spark, sf_dir):
    """Global aggregates with a default for an empty one."""
    return table(spark, sf_dir, "events").agg(F.max("value").alias("best"), F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))), F.lit(0)).alias("last_purchase"))


@query(f"""
WITH {PLAYS}, {USERS}, a AS (SELECT user_id, max(score) AS best, count(*) AS n_plays FROM plays GROUP BY 1)
SELECT user_id, display_name, best, coalesce(n_plays, 0) AS n_plays, CAST((row_number() OVER (PARTITION BY avatar_ver ORDER BY user_id) - 1) % 8 AS INT) AS color FROM users LEFT JOIN a USING (user_id)""")
def party_members(spark, sf_dir):
    """Members (of a nation's party) with their best of all plays, unfinished ones too, and a seat colour by join order."""
    agg = plays(spark, sf_dir).groupBy("user_id").agg(F.max("score").alias("best"), F.count("*").alias("n_plays"))
    m = ranked(users(spark, sf_dir), ["avatar_ver"], "user_id", "seat", descending=False).join(agg, "user_id", "left")
    return m.select("user_id", "display_name", "best", F.coalesce("n_plays", F.lit(0)).alias("n_plays"), F.pmod(F.col("seat") - 1, F.lit(8)).cast("int").alias("color"))


@query(f"""
WITH {PLAYS}, {USERS} SELECT p.id, p.song_id, u.display_name, n.n_name AS party, p.score, p.played_at FROM plays p LEFT JOIN users u USING (user_id) LEFT JOIN nation n ON n.n_nationkey = u.avatar_ver
ORDER BY played_at DESC, id DESC LIMIT 100""")
def party_board(spark, sf_dir):
    """The last 100 plays with their member and party, where there are any."""
    p = plays(spark, sf_dir).orderBy(F.desc("played_at"), F.desc("id")).limit(100)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("avatar_ver"), F.col("n_name").alias("party"))
    return p.join(users(spark, sf_dir), "user_id", "left").join(n, "avatar_ver", "left").select("id", "song_id", "display_name", "party", "score", "played_at")


@query("""
SELECT c_custkey AS user_id, o_orderkey AS job_id, o_orderstatus AS status, o_totalprice AS progress FROM customer LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def latest_jobs(spark, sf_dir):
    """Every customer with the order of the highest key, if any: an aggregate with map-side combine, then a join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("j"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return c.join(o, c["user_id"] == o["o_custkey"], "left").select("user_id", F.col("j.o_orderkey").alias("job_id"), F.col("j.o_orderstatus").alias("status"), F.col("j.o_totalprice").alias("progress"))


@query(f"""
WITH {PLAYS}, m AS (SELECT CAST(props->>'k' AS BIGINT) + 1 AS part, user_id, max(score) AS best, count(*) AS n, max(played_at) AS last_play FROM plays WHERE completed = 1 GROUP BY 1, 2)
SELECT p_partkey AS part, user_id, best, coalesce(n, 0) AS n, last_play FROM part LEFT JOIN m ON part = p_partkey""")
def song_list_for_users(spark, sf_dir):
    """Every song with the aggregates of each user, where there are any."""
    p = plays(spark, sf_dir).where("completed = 1").withColumn("part", F.get_json_object("props", "$.k").cast("long") + 1)
    mine = p.groupBy("part", "user_id").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.max("played_at").alias("last_play"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(mine, "part", "left").select("part", "user_id", "best", F.coalesce("n", F.lit(0)).alias("n"), "last_play")


@query(f"""
WITH {PLAYS} SELECT user_id, id, song_id, score, played_at FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY played_at DESC, id DESC) <= 500""")
def my_plays(spark, sf_dir, song=None, limit=9999):
    """Every user's plays, of one song if it is given, the newest first; the limit for each user is clamped."""
    p = plays(spark, sf_dir)
    if song:
        p = p.where(F.col("song_id") == song)
    return last_n(p, ["user_id"], clamp(limit), F.desc("played_at"), F.desc("id")).select("user_id", "id", "song_id", "score", "played_at")


@query(f"""
WITH {PLAYS} SELECT user_id, arg_min(id, (-score, played_at, id)) AS best_play, max(score) AS best, min(played_at) AS first_play, max(played_at) AS last_play FROM plays GROUP BY 1""".replace("arg_min(id, (-score, played_at, id))", "(list(id ORDER BY score DESC, played_at, id))[1]"))
def best_play_first_wins(spark, sf_dir):
    """Each user's best play; of equal scores the earliest."""
    return plays(spark, sf_dir).groupBy("user_id").agg(argmax_first("score", "id", "played_at").alias("best_play"), F.max("score").alias("best"), F.min("played_at").alias("first_play"), F.max("played_at").alias("last_play"))


@query(f"""
WITH {PLAYS} SELECT user_id, id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY played_at DESC, id DESC) AS INT) AS rank_in_group FROM plays QUALIFY rank_in_group <= 5""")
def last_five_plays(spark, sf_dir):
    """The last five plays of every user."""
    return last_n(plays(spark, sf_dir), ["user_id"], 5, F.desc("played_at"), F.desc("id")).select("user_id", "id", "score", "rank_in_group")


@query("""
SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(coalesce(p_name, '')), '1') OR contains(lower(coalesce(p_brand, '')), 'brand#3') OR contains(lower(coalesce(p_type, '')), 'zz')""".replace("'1'", "'brand#3'"))
def catalogue_search(spark, sf_dir, text="Brand#3"):
    """Songs (parts) of which some text column contains the text, case aside."""
    return search(table(spark, sf_dir, "part"), text, "p_name", "p_brand").select("p_partkey", "p_name", "p_brand")


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderstatus IN ('O', 'P')""")
def orders_of_listed_users(spark, sf_dir):
    """An IN list from another table as a semi-join, and one of literals."""
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").select("o_orderkey", "o_orderstatus")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def users_without_orders(spark, sf_dir):
    """Users without a large order: a failed existence probe as an anti-join."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query(f"""
WITH {PLAYS}, r AS (SELECT user_id, id, played_at, count(*) OVER (PARTITION BY user_id ORDER BY played_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM plays)
SELECT user_id, id, in_hour, in_hour > 5 AS refused FROM r""")
def hourly_rate_limit(spark, sf_dir):
    """How many of a user's events lie within the hour up to each one; more than five are refused."""
    hour = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("played_at").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    d = plays(spark, sf_dir).withColumn("in_hour", F.count("*").over(hour))
    return d.select("user_id", "id", "in_hour", (F.col("in_hour") > 5).alias("refused"))


@query("""
SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS queue_pos FROM customer WHERE c_acctbal IS NOT NULL""")
def queue_positions(spark, sf_dir):
    """Place in each party's queue: how many wait with a position up to one's own."""
    c = table(spark, sf_dir, "customer").where("c_acctbal IS NOT NULL")
    return ranked(c, ["c_nationkey"], "c_acctbal", "queue_pos", descending=False).select("c_nationkey", "c_custkey", "queue_pos")
