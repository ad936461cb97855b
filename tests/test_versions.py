"""Tables in versions and the boards kept in them: each batch once, readers never between two versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cadenza.sources.versions import Conflict, Versions
from cadenza.streaming import boards

SCHEMA = "k int, v string"
PLAYS = "id long, user_id long, song_id string, score double, played_at timestamp, completed int, max_combo int, party_code string, guest string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t", SCHEMA)
    assert rows(v.read()) == [] and v.versions() == []
    one, two = spark.createDataFrame([(1, "a"), (None, None)], SCHEMA), spark.createDataFrame([(2, "b")], SCHEMA)
    assert v.replace(one) == 1 and v.append(two) == 2
    assert rows(v.read()) == rows(one.union(two)) and rows(v.read(1)) == rows(one)
    assert v.append(two, "w", 0) == 3 and v.append(two, "w", 0) == 3 and v.append(two, "other", 0) == 4 and v.append(two, "w", 1) == 5
    assert v.read().count() == 6
    before = rows(v.read())
    assert v.compact() == 6 and rows(v.read()) == before and len(v.commit_of()["parts"]["all"]) == 1
    assert v.append(two, "w", 1) == 6  # a compacted table still knows its writers
    v.replace(two)
    v.trim(keep=2)
    assert v.versions() == [6, 7] and rows(v.read(6)) == before and rows(v.read()) == rows(two) and len(os.listdir(tmp_path / "t" / "data")) == 2


def test_a_failed_write_and_a_second_writer(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t", SCHEMA)
    one = spark.createDataFrame([(1, "a")], SCHEMA)
    v.replace(one)
    reader = v.read()
    with pytest.raises(Exception, match="broken"):
        v.replace(one.withColumn("v", F.raise_error(F.lit("broken")).cast("string")))
    assert rows(v.read()) == rows(one) and v.versions() == [1]
    other = Versions(spark, f"file://{tmp_path}/t", SCHEMA)
    was = other.commit_of()
    v.append(one)
    assert reader.count() == 1 and v.read().count() == 2  # what is being read doesn't change
    with pytest.raises(Conflict):
        other._commit(was, {"all": []}, None, None)
    assert v.read().count() == 2 and v.versions() == [1, 2]


def test_upserts_write_the_touched_buckets_alone(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t", "k int, n long", buckets=8)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    rng, want = random.Random(1), {}
    for batch in range(3):
        own = [(rng.choice([None, *range(20)]), rng.randint(1, 9)) for _ in range(3 if batch else 60)]
        before = v.commit_of()["parts"]
        new = spark.createDataFrame(own, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
        v.upsert(new, ["k"], add, "w", batch)
        v.upsert(new, ["k"], add, "w", batch)
        for k, n in own:
            want[k] = want.get(k, 0) + n
        assert dict(rows(v.read())) == want
        if batch:
            assert sum(p != before.get(b) for b, p in v.commit_of()["parts"].items()) <= 3
    assert v.upsert(new.limit(0), ["k"], add, "w", 9) == 4 and dict(rows(v.read())) == want


def plays(spark, n=400):
    rng = random.Random(3)
    made = [(i, rng.choice([None, 1, 2, 3]), rng.choice("ab"), rng.choice([None, 50.0, 75.25, rng.uniform(-5, 105)]), rng.randint(0, 1), rng.randint(-1, 5), rng.choice([None, "p"]), rng.choice([None, "g"])) for i in range(n)]
    return spark.createDataFrame([(i, u, s, x, None, c, m, p, g) for i, u, s, x, c, m, p, g in made], PLAYS).withColumn("played_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 7))


def test_a_board_through_restarts_and_repeated_batches(spark, tmp_path):
    from cadenza.sources.ingest import accepted

    p = plays(spark)
    for part in range(4):
        p.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/board"
    board, store = Versions(spark, path, boards.BOARD, buckets=4), Versions(spark, f"file://{tmp_path}/plays", PLAYS)
    stream = lambda: spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = boards.keep_board(stream(), board, f"{tmp_path}/ck", store, processingTime="0 seconds")
    q.processAllAvailable()
    q.stop()
    want = rows(boards.best_of(accepted(p)))
    assert rows(board.read()) == want and rows(store.read()) == rows(accepted(p)) and want
    # a batch whose end wasn't noted runs again after a restart
    (last,) = sorted(os.listdir(tmp_path / "ck" / "commits"), key=lambda n: (n.isdigit(), int(n) if n.isdigit() else 0))[-1:]
    for name in (last, f".{last}.crc"):
        os.rename(tmp_path / "ck" / "commits" / name, tmp_path / f"lost-{name}")
    q = boards.keep_board(stream(), board, f"{tmp_path}/ck", store, availableNow=True)
    q.awaitTermination()
    assert rows(board.read()) == want and store.read().count() == accepted(p).count()
    boards.update(board, p, 3)  # given twice
    assert rows(board.read()) == want
    boards.update(board, accepted(p.where("id < 10")), 4)
    assert board.read().agg(F.sum("n")).first()[0] > boards.best_of(accepted(p)).agg(F.sum("n")).first()[0]


def test_members_in_update_mode(spark, tmp_path):
    p = plays(spark)
    for part in range(2):
        p.where(F.col("id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = boards.members_now(s).writeStream.format("memory").queryName("members").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = {(r.party_code, r.member): (r.best, r.n) for r in sorted(spark.table("members").collect(), key=lambda r: r.n)}
    assert last == {(r.party_code, r.member): (r.best, r.n) for r in boards.members_now(p).collect()}
