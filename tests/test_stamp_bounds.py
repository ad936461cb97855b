"""A section whose mean accuracy is just at a stamp's bound has that stamp, in batch and stream."""

from pyspark.sql import functions as F

from cadenza.operators import scoring as S
from cadenza.streaming.scoring import score_stream

#: Of two notes eighths of a semitone that each frame is off, and how long the note is; the means are 0.3, 0.55, 0.3, 0.3.
PAIRS = [(((8,), 1.0), ((0, 0, 0, 0, 12, 12), 2.5)), (((0, 11, 12, 12, 12, 12), 2.5), ((0, 7), 0.5)), (((0, 11, 12, 12, 12, 12), 2.5), ((7,), 0.5)), (((10,), 3.5), ((0, 0, 0, 0, 0, 8), 2.5))]
WANT = {0: (0.3, "おしい…"), 1: (0.55, "いいね!"), 2: (0.3, "おしい…"), 3: (0.3, "おしい…")}


def test_sections_at_a_bound(spark, tmp_path):
    notes = [(s, i, 2.0 + 8 * i, 2.0 + 8 * i + d, 60) for s, pair in enumerate(PAIRS) for i, (_, d) in enumerate(pair)]
    midi = {(s, 2.0 + 8 * i + j / 4): 60 + m / 8 for s, pair in enumerate(PAIRS) for i, (off, _) in enumerate(pair) for j, m in enumerate(off)}
    frames = [(s, s, j / 4, midi.get((s, j / 4), 66.0)) for s in range(len(PAIRS)) for j in range(1, 64)]
    n = spark.createDataFrame(notes, "song_id long, pos int, t_start double, t_end double, midi int")
    f = spark.createDataFrame(frames, "session_id long, song_id long, t double, midi double")
    flips = spark.createDataFrame([(s, 0, 0.0, 20.0) for s in range(len(PAIRS))], "song_id long, section int, t0 double, t1 double")
    assert {r.session_id: (r.acc, r.stamp) for r in S.section_stamps(S.note_results(f, n), flips).collect()} == WANT

    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))
    end = spark.createDataFrame([(-1, 10_000.0, None)], "session_id long, t double, midi double")
    for part in (f.drop("song_id"), end):
        part.withColumn("at", at).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    f.select("session_id", "song_id").distinct().withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.parquet(f"{tmp_path}/starts")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    d = score_stream(read("in", "session_id long, t double, midi double, at timestamp"), read("starts", "session_id long, song_id long, at timestamp"), n, flips)
    q = d.writeStream.format("memory").queryName("bounds").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert {r.session_id: (r.acc, r.stamp) for r in spark.table("bounds").where("kind = 'stamp'").collect()} == WANT
