"""The stream gives what the batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import scoring as S
from cadenza.streaming import scoring as live


#: The session of song 2 that ends in the middle, and one an hour later.
QUIT, LATER = 6, 7


def tables(spark, tmp_path, shuffled=False):
    """frames and notes; in {tmp_path}/in the frames, in three files, then one of LATER; in {tmp_path}/starts the starts,
    those of odd sessions only in the second file."""
    rng = random.Random(4)
    notes = [(s, i, i * 1.0, i * 1.0 + rng.choice([0.5, 1.0, 1.75]), 60 + rng.randint(-6, 6)) for s in (1, 2) for i in range(12)]
    frames = []
    for session in range(7):
        t = 0.0
        while t < (6.3 if session == QUIT else 16):
            t = round(t + (2.5 if rng.random() < 0.02 else 0.125), 6)
            frames.append((session, 1 + session % 2, t, None if rng.random() < 0.1 else 60 + rng.randint(-20, 20) + rng.random()))
    n = spark.createDataFrame(notes, "song_id long, pos int, t_start double, t_end double, midi int").cache()
    f = spark.createDataFrame(frames, "session_id long, song_id long, t double, midi double").cache()
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))
    later = f.where("session_id = 0 AND t < 1").withColumn("session_id", F.lit(LATER).cast("long"))
    # shuffled: a file has frames from up to 8 seconds before what another one had already
    came = F.col("t") + (F.pmod(F.hash("t", "session_id"), F.lit(100)) * 0.07 if shuffled else 0)
    for part in [*(f.where((came > a) & (came <= b)).withColumn("at", at) for a, b in [(0, 5), (5, 11), (11, 99)]), later.withColumn("at", at + F.expr("INTERVAL 1 HOUR"))]:
        part.drop("song_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = f.select("session_id", "song_id").distinct().withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    for odd in (0, 1):
        s.where(F.col("session_id") % 2 == odd).coalesce(1).write.mode("append").parquet(f"{tmp_path}/starts")
    return f, n


def read(spark, tmp_path, name, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/{name}")


def scored(spark, tmp_path, notes, name, **how):
    d = live.score_stream(read(spark, tmp_path, "in", "session_id long, t double, midi double, at timestamp"), read(spark, tmp_path, "starts", "session_id long, song_id long, at timestamp"), notes, **how)
    q = d.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def rounded(x):
    return None if x is None else round(x, 6)


FLIPS = [(s, i, 3.0 * i, 3.0 * i + 3) for s in (1, 2) for i in range(4)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, tmp_path, shuffled):
    frames, notes = tables(spark, tmp_path, shuffled)
    flips = spark.createDataFrame(FLIPS, "song_id long, section int, t0 double, t1 double")
    rows = scored(spark, tmp_path, notes, f"scored{shuffled:d}", flips=flips, trace=True, late="8 seconds")
    got = [((x.session_id, x.pos), (x.rating, rounded(x.acc), rounded(x.cents))) for x in rows if x.kind == "note" and x.session_id != LATER]
    assert len(dict(got)) == len(got)
    batch = S.note_results(frames, notes)
    want = {(x.session_id, x.pos): (x.rating, rounded(x.acc), rounded(x.cents)) for x in batch.collect()}
    # what a session that went away left open is given out by its notes' timers
    left = {k: v for k, v in got if k not in want}
    assert 3 < sum(k[0] == QUIT for k in left) < 12 and all(v[:2] == (None, 0.0) for v in left.values())
    assert dict(got) == want | left and any(v[0] is None for v in want.values()) and len({v[0] for v in want.values()}) > 2
    last = {x.session_id: x for x in sorted(rows, key=lambda x: (x.max_combo, x.pos or 0)) if x.kind == "note"}
    scores = {x.session_id: x for x in S.session_scores(batch).collect()}
    assert all(last[s].max_combo == scores[s].max_combo for s in scores)
    stamps = {(x.session_id, x.pos): (rounded(x.acc), x.stamp) for x in rows if x.kind == "stamp"}
    assert stamps == {(x.session_id, x.section): (rounded(x.acc), x.stamp) for x in S.section_stamps(batch, flips).collect()} and len(stamps) > 12
    shown = {(x.session_id, rounded(x.t)): rounded(x.shown) for x in S.shown_pitches(S.frame_credits(frames, notes)).collect()}
    traces = [x for x in rows if x.kind == "trace"]
    assert all(x.trace[-1].t - x.trace[0].t <= live.SHOWN for x in traces) and any(x.trace[-1].t - x.trace[0].t > 4 for x in traces)
    traced = {(x.session_id, rounded(p.t)): rounded(p.shown) for x in traces if x.session_id != LATER for p in x.trace}
    assert traced == {k: shown[k] for k in traced} and len(traced) > 0.5 * len(shown)


def test_frames_without_a_start_and_odd_rows(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    frames = spark.createDataFrame([(1, 0.1, 60.0), (1, 0.2, None), (1, float("nan"), 60.0), (1, None, 60.0), (2, 0.1, 60.0), (2, 0.2, 61.0), (2, 0.2, 60.0), (2, 0.7, 60.0), (2, 0.9, 60.0)], "session_id long, t double, midi double")
    frames.withColumn("at", at(1)).coalesce(1).write.parquet(f"{tmp_path}/in")
    frames.limit(1).withColumns({"session_id": F.lit(9).cast("long"), "at": at(4000)}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    frames.limit(1).withColumns({"session_id": F.lit(9).cast("long"), "at": at(8000)}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    starts = spark.createDataFrame([(2, 1), (2, 1), (3, 8)], "session_id long, song_id long")
    starts.withColumn("at", at(0)).coalesce(1).write.parquet(f"{tmp_path}/starts")
    notes = spark.createDataFrame([(1, 0, 0.0, 0.5, 60), (1, 1, 0.6, 0.6, 60), (1, None, 0.0, 1.0, 60), (1, 2, None, 1.0, 60)], "song_id long, pos int, t_start double, t_end double, midi int")
    got = sorted((r.session_id, r.pos, r.rating, rounded(r.acc)) for r in scored(spark, tmp_path, notes, "odd"))
    # 0.7 comes half a second after 0.2 and doesn't count: 0.9 closes both
    assert got == [(2, 0, 0, 0.2), (2, 1, 0, 0.0)]


def test_daily_windows(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", "view", float(h)) for d in (1, 2, 3) for h in (1, 2)]
    e = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.coalesce(1).write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    q = live.daily_counts(s).writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.window.start)[:10], r.n, r.best) for r in spark.table("days").collect()) == [(f"2024-01-0{d}", 2, 2.0) for d in (1, 2, 3)]
