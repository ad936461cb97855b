"""Live boards: a stream of plays, appended to a table and merged into boards, each batch once.

A batch's plays are aggregated before they meet the table, and only the buckets of the keys that it touches are written anew
(sources.versions). Every batch is committed with its number, so one that comes again, after a restart or given twice,
changes nothing, and readers see the board before a batch or after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.sources.ingest import accepted
from cadenza.sources.versions import Versions

BOARD = "song_id string, user_id long, best double, since timestamp, play_id long, n long, last timestamp"


def best_of(plays: DataFrame) -> DataFrame:
    """song_id, user_id, best (score, the earliest play of it first), n, last of finished plays."""
    first_best = F.min(F.struct((-F.col("score")).alias("s"), "played_at", "id"))
    d = plays.where("completed = 1 AND user_id IS NOT NULL AND score IS NOT NULL").groupBy("song_id", "user_id")
    d = d.agg(first_best.alias("b"), F.count("*").alias("n"), F.max("played_at").alias("last"))
    return d.select("song_id", "user_id", (-F.col("b.s")).alias("best"), F.col("b.played_at").alias("since"), F.col("b.id").alias("play_id"), "n", "last")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both boards as one: mergeable, so a batch's plays are aggregated before they meet the table."""
    first_best = F.min(F.struct((-F.col("best")).alias("s"), "since", "play_id"))
    d = old.unionByName(new).groupBy("song_id", "user_id").agg(first_best.alias("b"), F.sum("n").alias("n"), F.max("last").alias("last"))
    return d.select("song_id", "user_id", (-F.col("b.s")).alias("best"), F.col("b.since").alias("since"), F.col("b.play_id").alias("play_id"), "n", "last")


def update(board: Versions, plays: DataFrame, batch: int, writer: str = "board") -> int:
    """The board with a batch of plays."""
    return board.upsert(best_of(plays), ["song_id", "user_id"], merged, writer, batch)


def keep_board(plays: DataFrame, board: Versions, checkpoint: str, store: Versions | None = None, writer: str = "board", **trigger) -> StreamingQuery:
    """Starts a query that keeps `board` up to date with a stream of plays (id, user_id, song_id, score, played_at,
    completed, ...) and, if there is a store, appends to it the valid plays of its columns."""

    def step(df: DataFrame, batch: int) -> None:
        df = accepted(df)
        if store is not None:
            store.append(df, writer, batch)
        update(board, df, batch, writer)

    return plays.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"})).start()


def members_now(plays: DataFrame) -> DataFrame:
    """party_code, member, best, n of every party member with a play in a batch (update mode): unfinished plays count."""
    d = plays.where("party_code IS NOT NULL").groupBy("party_code", F.coalesce(F.col("user_id").cast("string"), F.col("guest")).alias("member"))
    return d.agg(F.max("score").alias("best"), F.count("*").alias("n"))
