"""Scoring of sung frames against a song's notes, as one batch."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from cadenza.functions.scalars import credit, folded, rating, stamp, total_score
from cadenza.operators.folds import fold_groups
from cadenza.operators.joins import asof, stab
from cadenza.operators.sequence import by, combos

#: A frame counts if it comes less than so many seconds after the one before; a note that is closed later
#: than so many seconds after its end wasn't attempted.
LONGEST_FRAME, LATE = 0.3, 1.5
#: Digits of the seconds that a note was hit and of a section's mean accuracy: the order of a sum shows beyond them alone. A
#: mean has fewer, as what was cut off its notes adds up.
EXACT, MEAN = 12, 11


def frame_credits(frames: DataFrame, notes: DataFrame) -> DataFrame:
    """session_id, song_id, t, midi, dt, pos, distance, credit of the frames that count. frames: session_id, song_id, t
    (the song's clock), midi or null; latency_ms, if there is one, is taken off t first."""
    d = frames.withColumn("t", F.col("t") - F.col("latency_ms") / 1000.0) if "latency_ms" in frames.columns else frames
    d = d.withColumn("dt", F.col("t") - F.lag("t").over(by(["session_id"], ["t", "midi"]))).where((F.col("dt") > 0) & (F.col("dt") < LONGEST_FRAME))
    n = notes.select("song_id", "pos", "t_start", "t_end", F.col("midi").alias("note_midi"))
    d = stab(d.select("session_id", "song_id", "t", "midi", "dt"), n, ["song_id"], "t", ("t_start", "t_end"), ["pos", "note_midi"], 4.0, ["session_id", "song_id", "t"])
    cents = folded(F.col("midi"), F.col("note_midi")) - F.col("note_midi")
    d = d.withColumn("off", cents).withColumn("distance", F.abs("off"))
    return d.withColumn("credit", F.when(F.col("distance").isNotNull(), credit(F.col("distance"))))


def note_results(frames: DataFrame, notes: DataFrame) -> DataFrame:
    """session_id, song_id, pos, acc, cents, rating (null if not attempted), closed_at, combo of every note that a session
    got past. Notes are closed by the first frame after their end."""
    f = frame_credits(frames, notes)
    near = F.col("distance") <= 1.6
    # Rounded, so that a note just at a rating's bound is rated alike in whatever order its frames are summed.
    own = f.where("distance IS NOT NULL").groupBy("session_id", "pos").agg(
        F.round(F.sum(F.col("dt") * F.col("credit")), EXACT).alias("hit"), F.sum("dt").alias("sung"),
        F.sum(F.when(near, F.col("off") * 100 * F.col("dt"))).alias("_c"), F.sum(F.when(near, F.col("dt"))).alias("_w"))
    due = f.select("session_id", "song_id").distinct().join(notes.select("song_id", "pos", "t_start", "t_end"), "song_id")
    closed = asof(due.withColumn("after", F.col("t_end") + 1e-9), f.select("session_id", F.col("t").alias("closed_at")), ["session_id"], "after", "closed_at", ["closed_at"], forward=True)
    d = closed.where("closed_at IS NOT NULL").join(own, ["session_id", "pos"], "left")
    late = F.col("closed_at") - F.col("t_end") > LATE
    acc = F.when(late, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("hit", F.lit(0.0)) / (F.col("t_end") - F.col("t_start"))))
    d = d.select("session_id", "song_id", "pos", "t_start", "t_end", "closed_at", acc.alias("acc"), (F.col("_c") / F.col("_w")).alias("cents"), F.coalesce("hit", F.lit(0.0)).alias("hit"), late.alias("_late"))
    d = d.withColumn("rating", F.when(~F.col("_late"), rating(F.col("acc")))).drop("_late")
    return combos(d, ["session_id"], ["closed_at", "t_start", "pos"], F.col("rating") > 0)


def session_scores(results: DataFrame) -> DataFrame:
    """session_id, score, n_perfect, n_great, n_good, n_miss, max_combo of the attempted notes."""
    dur = F.col("t_end") - F.col("t_start")
    done = F.col("rating").isNotNull()
    n = lambda r: F.count_if(F.col("rating") == r)
    d = results.groupBy("session_id").agg(
        F.sum(F.when(done, F.least("hit", dur))).alias("_hit"), F.sum(F.when(done, dur)).alias("_dur"),
        n(3).alias("n_perfect"), n(2).alias("n_great"), n(1).alias("n_good"), n(0).alias("n_miss"), F.max("combo").alias("max_combo"))
    return d.withColumn("score", total_score(F.col("_hit"), F.col("_dur"))).drop("_hit", "_dur")


def section_stamps(results: DataFrame, flips: DataFrame) -> DataFrame:
    """session_id, section, acc, stamp of every page with two attempted notes or more. flips: song_id, t0, t1, section."""
    d = results.where("rating IS NOT NULL").join(flips, "song_id").where("t_end > t0 AND t_end <= t1 + 0.2")
    d = d.groupBy("session_id", "section").agg(F.round(F.avg("acc"), MEAN).alias("acc"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    return d.withColumn("stamp", stamp(F.col("acc")))


def shown_pitches(credits: DataFrame) -> DataFrame:
    """session_id, t, shown of the frames of frame_credits() that have a pitch: the pitch in the octave nearest to the note
    that sounds; without one, to what was shown last, so that a line of song doesn't jump. One number of state a session;
    rows stream in order."""

    def fold(rows: Iterable[dict]) -> Iterator[tuple]:
        last = None
        for r in rows:
            target = next(x for x in (r["note_midi"], last, r["midi"]) if x is not None)
            last = r["midi"] + 12 * math.floor((target - r["midi"]) / 12 + 0.5)
            yield r["t"], last

    d = credits.where("midi IS NOT NULL").select("session_id", F.col("t").cast("double").alias("t"), F.col("midi").cast("double").alias("midi"), F.col("note_midi").cast("double").alias("note_midi"))
    return fold_groups(d, ["session_id"], ["t", "midi", "note_midi"], "t double, shown double", fold, order=["t"])


def finished(results: DataFrame, notes: DataFrame) -> DataFrame:
    """The row that each session's end leaves: session_id, song_id, score (0 if too little was sung), the counts,
    max_combo, completed (all notes of the song were passed) and results, a triple for every note of the song: its
    rating, accuracy and cents, or null, 0, null. A session in which no note was attempted leaves none."""
    song = results.select("session_id", "song_id").distinct().join(notes.select("song_id", "pos"), "song_id")
    d = song.join(results.select("session_id", "pos", "rating", "acc", "cents"), ["session_id", "pos"], "left")
    done = F.col("rating").isNotNull()
    text = lambda c, none: F.coalesce(c.cast("string"), F.lit(none))
    triple = F.concat(F.lit("["), text(F.col("rating"), "null"), F.lit(","), F.when(done, text(F.round("acc", 3), "0")).otherwise("0"), F.lit(","), F.when(done, text(F.round("cents").cast("long"), "null")).otherwise("null"), F.lit("]"))
    d = d.select("session_id", "song_id", "pos", done.alias("_done"), triple.alias("_t"))
    ends = d.groupBy("session_id", "song_id").agg(F.max("_done").alias("_any"), F.concat(F.lit('{"notes":['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), ","), F.lit("]}")).alias("results"), F.count("*").alias("_n"))
    passed = results.groupBy("session_id").agg(F.count("*").alias("_passed"))
    d = ends.where("_any").join(passed, "session_id").join(session_scores(results), "session_id")
    return d.withColumns({"completed": F.col("_passed") == F.col("_n"), "score": F.round(F.coalesce("score", F.lit(0.0)), 3)}).drop("_any", "_n", "_passed")
