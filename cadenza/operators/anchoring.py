"""Which absolute pitch a song's rows of notes stand for, by the energy of its sound at the notes' times.

A note is a weight on each of its frames. Weights of one row of the lattice and one frame are summed up before they meet the
frame's vector, vectors element by element, a column each, so sums combine before they are shuffled, and all notes of a row
before any hypothesis is tried: a hypothesis gathers one element from each row's vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.robust import best_hypothesis
from cadenza.operators.selection import join_few

#: What of a note's beginning and end is left out, the weight of the octave above, the range in which the
#: median of a song's pitches has to lie, the least mean that a frame is divided by.
LEFT_OUT, OCTAVE, SUNG, LEAST = 0.15, 0.35, (53, 76), 1e-6


def weighed(energy: Column, size: int) -> Column:
    """log(1 + energy) of a frame, over its mean, so that loud stretches don't outweigh others. Null elements are 0."""
    logs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.log1p(F.get(energy, i).cast("double")), F.lit(0.0)))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / size
    return F.transform(logs, lambda x: x / F.greatest(mean, F.lit(LEAST)))


def frame_weights(frames: DataFrame, notes: DataFrame, song: str, pos: str, row: str, step: float) -> DataFrame:
    """song, row, frame, weight: how much a frame (song, frame) counts for the notes of a row, each of which spreads 1 over
    the frames that there are in its middle (t_start, t_end), one at least. Notes from the first one, by pos, that reaches
    beyond the last frame are left out. Notes of one row with the same middle are counted before they meet their frames."""
    dur = F.col("t_end") - F.col("t_start")
    a = F.floor((F.col("t_start") + LEFT_OUT * dur) / step)
    n = notes.where(F.col(pos).isNotNull()).select(song, pos, F.col(row).cast("int").alias(row), a.alias("_a"), F.floor((F.col("t_end") - LEFT_OUT * dur) / step).alias("_b"))
    n = join_few(n.withColumn("_b", F.greatest(F.col("_a") + 1, "_b")), frames.groupBy(song).agg((F.max("frame") + 1).alias("_frames")), [song])
    first = n.groupBy(song).agg(F.min(F.when(F.col("_b") > F.col("_frames"), F.col(pos))).alias("_first"))
    n = join_few(n, first, [song]).where(F.col("_first").isNull() | (F.col(pos) < F.col("_first")))
    n = n.groupBy(song, row, "_a", "_b").agg(F.count("*").alias("_m"))
    d = n.withColumn("frame", F.explode(F.sequence("_a", F.col("_b") - 1))).join(frames.groupBy(song, "frame").agg(F.count("*").alias("_d")), [song, "frame"])
    d = d.groupBy(song, row, "_a", "_b").agg((F.first("_m") / F.sum("_d")).alias("weight"), F.collect_list("frame").alias("_f"))
    return d.select(song, row, F.explode("_f").alias("frame"), "weight").groupBy(song, row, "frame").agg(F.sum("weight").alias("weight"))


def anchored(frames: DataFrame, notes: DataFrame, song: str, pos: str, row: str, step: float, low: int, size: int, energy: str = "energy") -> DataFrame:
    """song, base, score, margin: the base for which the energy at base + row of all notes, and OCTAVE of that an octave
    above, is the greatest on the average; how far the next one is below. Element i of a frame is pitch low + i. A base
    must keep all rows of the song's notes (also of those left out) within the elements, and their median in SUNG."""
    both = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(energy, i) + OCTAVE * F.coalesce(F.get(energy, i + 12), F.lit(0.0)))
    v = frames.select(song, "frame", weighed(F.col(energy), size).alias(energy)).withColumn(energy, both)
    d = frame_weights(frames, notes, song, pos, row, step).join(v, [song, "frame"])
    d = d.groupBy(song, row).agg(F.sum("weight").alias("_w"), *[F.sum(F.get(energy, F.lit(i)) * F.col("weight")).alias(f"_e{i}") for i in range(size)])
    sums = d.select(song, row, "_w", F.array(*[f"_e{i}" for i in range(size)]).alias(energy))
    span = notes.groupBy(song).agg(F.min(row).alias("_min"), F.max(row).alias("_max"), F.median(row).alias("_median"))
    bases = F.explode(F.filter(F.sequence(F.lit(low), F.lit(low + size - 1)), lambda b: (b + F.col("_min") >= low) & (b + F.col("_max") < low + size) & (b + F.col("_median")).between(*SUNG)))
    d = sums.join(span.select(song, bases.alias("base")), song).groupBy(song, "base").agg(F.sum(F.get(energy, F.col("base") + F.col(row) - low)).alias("_sum"), F.round(F.sum("_w")).alias("_n"))
    scores = d.select(song, "base", (F.col("_sum") / F.col("_n")).alias("score"))
    return best_hypothesis(scores, [song], "base", "score")
