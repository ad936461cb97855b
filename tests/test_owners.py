"""Owners filled in from claims, and sign-in limits on a stream."""

from pyspark.sql import functions as F

from cadenza.operators.relational import backfill
from cadenza.streaming.scoring import recent_requests


def test_backfilled_owners(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, 7, "a"), (3, None, None), (4, None, "z")], "id int, owner int, seat string")
    claims = spark.createDataFrame([("a", 9), ("a", 8), (None, 5), ("a", None)], "seat string, user int")
    assert sorted((r.id, r.owner) for r in backfill(d, "owner", claims, ["seat"], "user").collect()) == [(1, 8), (2, 7), (3, None), (4, None)]
    assert backfill(d.limit(0), "owner", claims, ["seat"], "user").count() == 0


def test_requests_of_sliding_hours(spark, tmp_path):
    at = [0, 10, 59, 61, 200]
    e = spark.createDataFrame([(1, m) for m in at] + [(2, 0)], "user_id int, m int").select("user_id", F.timestamp_seconds(F.lit(1_700_000_000 // 3600 * 3600) + 60 * F.col("m")).cast("timestamp_ntz").alias("ts"))
    e.coalesce(1).write.parquet(f"{tmp_path}/e")
    q = recent_requests(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")).writeStream.format("memory").queryName("recent").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    base = 1_700_000_000 // 3600 * 60
    got = {(r.user_id, int(r.window.start.timestamp()) // 60 - base): r.n for r in spark.table("recent").collect()}
    want = {}
    for user, m in [(1, m) for m in at] + [(2, 0)]:
        for start in range(m // 5 * 5 - 55, m // 5 * 5 + 5, 5):
            want[user, start] = want.get((user, start), 0) + 1
    assert got == want
