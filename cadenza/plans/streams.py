"""Queries that run a stream over the given tables to its end and read what it left."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.plans.boards import DONE
from cadenza.plans.live import RESULTS, frames
from cadenza.plans.registry import query
from cadenza.plans.views import PLAYS, notes, plays
from cadenza.sources.shared import kept, shared_path
from cadenza.sources.versions import Versions
from cadenza.streaming import boards
from cadenza.streaming.scoring import RESULT, score_stream

#: Batches that a table is streamed in.
BATCHES = 4


def streamed(df, name: str, last=None):
    """df as a stream of BATCHES batches, and one of `last`."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.repartition(BATCHES).write.parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"""
WITH {PLAYS} SELECT song_id, user_id, max(round(score, 3)) AS best, arg_min(id, (-round(score, 3), played_at, id)) AS play_id, count(*) AS n FROM plays WHERE {DONE} AND score BETWEEN 0 AND 100 GROUP BY 1, 2""")
def live_board(spark, sf_dir):
    """The board that a stream of plays leaves, merged batch by batch."""
    path = shared_path(spark, "board")
    p = plays(spark, sf_dir).withColumns({"played_at": F.col("played_at").cast("timestamp"), "max_combo": F.lit(0)})
    board = Versions(spark, path, boards.BOARD, buckets=16)
    boards.keep_board(streamed(p, "plays"), board, f"{path}/checkpoint", availableNow=True).awaitTermination()
    return board.read().select("song_id", "user_id", "best", "play_id", "n")


@query(f"WITH {RESULTS} SELECT session_id, pos, CAST(rating AS INT) AS rating, round(acc, 6) AS acc, round(cents, 4) AS cents FROM r WHERE rating IS NOT NULL")
def live_note_results(spark, sf_dir):
    """Accuracy, rating and cents of every attempted note, by the stream: frames come in no order."""
    f = frames(spark, sf_dir)
    at = lambda t: F.timestamp_seconds(F.lit(1_700_000_000) + t)
    sung = f.select("session_id", at(F.col("t")).alias("at"), F.col("t").cast("double").alias("t"), F.col("midi").cast("double").alias("midi"))
    # A frame of nobody's, long after all others, lets the watermark pass them.
    end = f.agg(F.max("t").alias("t")).where("t IS NOT NULL").select(F.lit(-1).cast("long").alias("session_id"), at(F.col("t") + 1_000_000).alias("at"), F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("midi"))
    starts = f.select("session_id", "song_id").distinct().withColumn("at", at(F.lit(0)))
    # written once: every batch reads them again
    songs = kept(notes(spark, sf_dir, f).select("song_id", "pos", "t_start", "t_end", "midi"), "notes")
    scored = score_stream(streamed(sung, "frames", end), streamed(starts, "starts"), songs, late="2 days")
    path = shared_path(spark, "scored")
    out = Versions(spark, path, RESULT)
    scored.writeStream.foreachBatch(lambda df, batch: out.append(df, "scorer", batch) and None).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    d = out.read().where("kind = 'note' AND rating IS NOT NULL")
    return d.select("session_id", "pos", "rating", F.round("acc", 6).alias("acc"), F.round("cents", 4).alias("cents"))
