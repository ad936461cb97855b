"""Submitted plays: what is valid goes on, what isn't is set aside with a reason; results are parsed tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.selection import join_few, quantiles

# Bounds of a score, and the longest results text.
SCORE, LONGEST = (0.0, 100.0), 300_000


def checked(plays: DataFrame) -> DataFrame:
    """plays with reason, null if the play is valid: the first rule that it breaks."""
    score = F.col("score")
    reason = F.when(score.isNull() | F.isnan(score), "no score").when((score < SCORE[0]) | (score > SCORE[1]), "score out of bounds").when(F.col("max_combo") < 0, "negative combo")
    return plays.withColumn("reason", reason)


def count_of(x: Column) -> Column:
    """A count of at least 0; what isn't a number is 0."""
    return F.greatest(F.lit(0), F.coalesce(x.try_cast("int"), F.lit(0)))


def accepted(plays: DataFrame) -> DataFrame:
    """Valid plays as they are stored: scores of three places, sane counts, overlong results left out."""
    d = checked(plays).where("reason IS NULL").drop("reason").withColumn("score", F.round("score", 3))
    for c in ("n_perfect", "n_great", "n_good", "n_miss"):
        if c in d.columns:
            d = d.withColumn(c, count_of(F.col(c)))
    if "results" in d.columns:
        d = d.withColumn("results", F.when(F.length("results") <= LONGEST, F.col("results")))
    return d


def rejected(plays: DataFrame) -> DataFrame:
    return checked(plays).where("reason IS NOT NULL")


def note_results(plays: DataFrame) -> DataFrame:
    """id, song_id, pos, rating, acc, cents of every entry of results with two numbers at least; texts that aren't JSON
    have none."""
    d = plays.select("id", "song_id", F.from_json("results", "notes array<array<double>>")["notes"].alias("_n"))
    d = d.select("id", "song_id", F.posexplode("_n").alias("pos", "r")).where("size(r) >= 2")
    return d.select("id", "song_id", "pos", F.get("r", F.lit(0)).cast("int").alias("rating"), F.coalesce(F.get("r", F.lit(1)), F.lit(0.0)).alias("acc"), F.get("r", F.lit(2)).alias("cents"))


# The least height of a bar, its share of a picture's median height, widths from which a track counts for
# that, the median where no track counts.
THIN, SHARE_OF_MEDIAN, COUNTS, TYPICAL = 8.0, 0.6, 7, 18.0


def with_thin(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """tracks (x0, x1, h, ...) with thin, the height below which a bar of its keys is too thin: bars differ from skin to skin."""
    m = quantiles(tracks.where(F.col("x1") - F.col("x0") >= COUNTS), keys, "h", {"_median": 0.5})
    every = tracks.select(*keys).distinct().join(m.toDF(*[f"_m_{k}" for k in keys], "_median"), [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys], "left")
    thin = F.greatest(F.lit(THIN), SHARE_OF_MEDIAN * F.coalesce("_median", F.lit(TYPICAL)))
    return join_few(tracks, every.select(*keys, thin.alias("thin")), keys)


def track_reason(loose: bool = False, scale: float = 1.0, thin: float | Column = THIN) -> Column:
    """Why a track is rejected, null if it is kept; the first rule that holds decides. Columns: x0, x1, first_f, last_f,
    first_w, hits, h."""
    c = F.col
    w, life = c("x1") - c("x0"), c("last_f") - c("first_f")
    grew, rate = c("x1") - (c("x0") + c("first_w")), c("hits") / (life + 1)
    saved = (w >= 12) & (c("h") >= thin) if loose else F.lit(False)
    return F.when(w < 7, "tiny").when((life < 2) & ~saved, "tiny").when(life < 2, None).when((grew < 3) & (w > 26), "static").when(rate < (0.45 if loose else 0.55), "flicker").when(c("h") < thin, "thin").when((life < 6 * scale) & (grew < 3), "remnant")
