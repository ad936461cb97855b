"""Exact percentiles of groups of any size, and bisection of many sorted sequences at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.sources.shared import kept

#: Rows from which a group is too large for one task; a sketch's accuracy: its quantiles are off by n / ACCURACY ranks at most.
LARGE, ACCURACY = 1_000_000, 20_000
#: Rows up to which a table of groups is broadcast.
FEW = 100_000


def join_few(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """df joined with a row for each of its keys, null equal to null: by a broadcast, so that no key is dealt to one task,
    where there are FEW groups at most; where there are more, by a shuffle in which AQE splits what is skewed."""
    g = kept(groups, "groups")
    small = g.toDF(*[f"_k_{c}" if c in keys else c for c in g.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(F.broadcast(small) if g.count() <= FEW else small, same).drop(*[f"_k_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], large: int = LARGE, accuracy: int = ACCURACY) -> DataFrame:
    """keys and, under each name of `at`, the exact quantile of the numbers of a group, interpolated between two ranks (as
    percentile and quantile_cont do). Nulls don't count; a group of nulls has no row; NaN is the greatest.

    Groups of at most `large` rows are taken whole. Of a larger one a mergeable sketch says between which two values a rank
    lies; the rows below are counted, and only those between, 4 / accuracy of the group, are put in order, after equal ones
    have become one with a count. Where a sketch was wrong about a rank, which its guarantee excludes, it is asked for more.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    n = kept(d.groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    own = lambda x: [F.col(k).alias(f"_k_{k}") for k in keys]
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    hot = n.where(F.col("_n") > large)
    if hot.isEmpty():
        return d.groupBy(*keys).agg(*[F.percentile("_x", q).alias(name) for name, q in at.items()])
    few = F.broadcast(hot.select(*own(0), "_n")) if hot.count() <= FEW else hot.select(*own(0), "_n")
    whole = d.join(few, same, "left_anti") if keys else d.limit(0)
    out = whole.groupBy(*keys).agg(*[F.percentile("_x", q).alias(name) for name, q in at.items()]) if keys else None
    rows = d.join(few, same) if keys else d.crossJoin(few)
    rows = rows.drop(*[f"_k_{k}" for k in keys])
    ranks = sorted({(name, edge) for name in at for edge in (0, 1)})
    # the rank below a quantile and the one above it
    rank = {r: (F.floor if r[1] == 0 else F.ceil)(F.lit(at[r[0]]) * (F.col("_n") - 1)) for r in ranks}
    slack = 2 / accuracy
    while True:
        cuts = [min(1.0, max(0.0, at[r[0]] + side * slack)) for r in ranks for side in (-1, 1)]
        b = rows.groupBy(*keys, "_n").agg(F.percentile_approx("_x", cuts, accuracy).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        low = lambda i: F.when(F.lit(cuts[2 * i]) <= 0, F.col("_least")).otherwise(F.col("_c")[2 * i])
        high = lambda i: F.when(F.lit(cuts[2 * i + 1]) >= 1, F.col("_most")).otherwise(F.col("_c")[2 * i + 1])
        spans = F.array(*[F.struct(F.lit(i).alias("i"), rank[r].alias("rank"), low(i).alias("low"), high(i).alias("high")) for i, r in enumerate(ranks)])
        b = kept(b.select(*keys, spans.alias("_s")), "spans")
        met = join_few(rows.drop("_n"), b, keys) if keys else rows.drop("_n").crossJoin(F.broadcast(b))
        below = met.groupBy(*keys).agg(F.array(*[F.count_if(F.col("_x") < F.col("_s")[i]["low"]) for i in range(len(ranks))]).alias("_below"))
        inside = met.select(*keys, "_x", F.explode(F.filter("_s", lambda s: (F.col("_x") >= s["low"]) & (F.col("_x") <= s["high"]))).alias("_p"))
        inside = inside.groupBy(*keys, F.col("_p.i").alias("_i"), F.col("_p.rank").alias("_rank"), "_x").agg(F.count("*").alias("_m"))
        up_to = F.sum("_m").over(W.partitionBy(*keys, "_i").orderBy("_x"))
        inside = inside.withColumn("_to", up_to)
        inside = join_few(inside, below, keys) if keys else inside.crossJoin(F.broadcast(below))
        before = F.get("_below", F.col("_i"))
        hit = inside.where((before + F.col("_to") - F.col("_m") <= F.col("_rank")) & (F.col("_rank") < before + F.col("_to")))
        hit = kept(hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_x"))).alias("_v"), F.count("*").alias("_found")), "ranks")
        if hit.where(F.col("_found") == len(ranks)).count() == hot.count():
            break
        slack *= 10
    v = lambda name, edge: F.col("_v")[ranks.index((name, edge))]
    hit = join_few(hit, hot, keys) if keys else hit.crossJoin(F.broadcast(hot))
    part = lambda q: F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1))
    between = lambda name, q: F.when(part(q) == 0, v(name, 0)).otherwise(v(name, 0) + (v(name, 1) - v(name, 0)) * part(q))
    found = hit.select(*keys, *[between(name, q).alias(name) for name, q in at.items()])
    return found if out is None else out.unionByName(found)


def bisected(requests: DataFrame, frames: DataFrame, keys: list[str], at: str, low: str, high: str, holds: Column, name: str = "flip") -> DataFrame:
    """requests with the first place after `low`, up to `high`, at which `holds`, a condition on the columns of frames (and on
    the request's own, as _r.column), is true; null where it isn't true at `high`. It must not turn false again between the two; a place that frames (a row for
    each of keys and `at`) doesn't have counts as false.

    All requests are bisected at once: a round joins one place for each that is open to the frames, so `holds` is worked out
    for as many frames as there are open requests, and the rounds are as many as the widest span has binary digits.
    requests is told apart by all of its columns, and repeated rows stay repeated.
    """
    held = frames.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(at).alias("_at"), *[F.col(c).alias(c) for c in frames.columns if c not in (*keys, at)])

    def asked(d: DataFrame) -> DataFrame:
        """d with _is: whether the condition holds at _probe."""
        d = d.withColumn("_r", F.struct("*")).select("_r", *keys, "_probe")
        same = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_probe") == F.col("_at")]
        return d.join(held, same, "left").select("_r.*", F.coalesce(holds & F.col("_at").isNotNull(), F.lit(False)).alias("_is"))

    d = kept(requests.withColumns({"_lo": F.col(low).cast("long"), "_hi": F.col(high).cast("long"), "_probe": F.col(high).cast("long")}), "requests")
    widest = d.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 0
    d = kept(asked(d).withColumn("_ends", F.col("_is") & (F.col("_hi") > F.col("_lo"))).drop("_is"), "bisected")
    for _ in range(max(0, math.ceil(math.log2(widest))) if widest > 1 else 0):
        open_ = F.col("_ends") & (F.col("_hi") - F.col("_lo") > 1)
        probes = asked(d.where(open_).withColumn("_probe", F.expr("(_lo + _hi) div 2")))
        probes = probes.withColumns({"_hi": F.when(F.col("_is"), F.col("_probe")).otherwise(F.col("_hi")), "_lo": F.when(F.col("_is"), F.col("_lo")).otherwise(F.col("_probe"))}).drop("_is")
        d = kept(probes.unionByName(d.where(~open_)), "bisected")
    return d.select(*requests.columns, F.when(F.col("_ends"), F.col("_hi")).alias(name))
