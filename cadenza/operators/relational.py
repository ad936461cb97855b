"""Grouped tops, ranks and snapshots that the boards and feeds share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.sources.shared import kept


def falsy_coalesce(*columns: Column) -> Column:
    """The first value that is neither null nor zero nor empty; the last one as it is."""
    *most, last = columns
    return F.coalesce(*[F.when(~c.cast("string").isin("", "0", "0.0", "-0.0", "false"), c) for c in most], last)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in `order`, which should be total."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of every key in `order`, numbered from 1 as rank_in_group."""
    return df.withColumn("rank_in_group", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank_in_group") <= n)


def argmax_first(value: str, what: str, *ties: str) -> Column:
    """Aggregate: `what` at the greatest `value`; of equal ones the first by `ties` and then `what`."""
    return F.min_by(what, F.struct(-F.col(value), *ties, what))


def ranked(df: DataFrame, keys: list[str], value: str, name: str = "rank", descending: bool = True, each: int = 50_000, most: int = 256) -> DataFrame:
    """df with 1 + how many rows of its keys (all rows, without keys) have a better value. A key may be hot: rows are
    dealt by keys and ranges of values, of about `each` rows and `most` at most, ranked within a range, and the counts of
    the better ranges, a row for each key and range, are added. Nulls come last. The driver sees the ranges' bounds only.
    df is computed once, as a written table; where it is one range, a window is all."""
    df = kept(df, "ranked")
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    n = df.count()
    ranges = int(max(1, min(most, n // each)))
    cuts = sorted(set(df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [])) if ranges > 1 else []
    if not cuts:
        return df.withColumn(name, F.rank().over(W.partitionBy(*keys).orderBy(order)).cast("long"))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast(f"array<{dict(df.dtypes)[value]}>")
    at = F.size(F.filter(bounds, lambda c: c <= F.col(value)))
    cell = F.when(F.col(value).isNull(), len(cuts) + 1).otherwise(len(cuts) - at if descending else at)
    d = df.withColumn("_cell", cell).withColumn(name, F.rank().over(W.partitionBy(*keys, "_cell").orderBy(order)))
    sizes = df.withColumn("_cell", cell).groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    better = F.sum("_n").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cell").alias("_c"), F.coalesce(better, F.lit(0)).alias("_better"))
    same = F.col("_cell") == F.col("_c")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return d.join(sizes, same).withColumn(name, F.col(name) + F.col("_better")).drop("_cell", "_c", "_better", *[f"_k_{k}" for k in keys])


def top_ranked(df: DataFrame, n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first n rows in `order`, numbered from 1: the limit comes first, so only n rows are ever numbered."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(W.orderBy(*order)))


def backfill(df: DataFrame, column: str, claims: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with the nulls of a column filled by the claims (keys, value) of their keys: the least where there are several.
    What has a value keeps it; a null key claims nothing."""
    c = claims.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(value).alias("_claimed"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_k_{k}")
    d = df.join(c, same & F.col(column).isNull(), "left")
    return d.withColumn(column, F.coalesce(column, "_claimed")).drop("_claimed", *[f"_k_{k}" for k in keys])


def clamp(n: int, low: int = 1, high: int = 500) -> int:
    return max(low, min(n, high))


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which some column contains the text, case aside; null is empty."""
    found = F.lit(False)
    for c in columns:
        found |= F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return df.where(found)


def merge(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], fill: list[str]) -> DataFrame:
    """A new snapshot: rows of either; `overwrite` columns take new values where there are any, `fill` columns only
    where the old ones are null, others stay."""
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    j = old.join(n, F.col(key) == F.col("_key"), "full_outer")
    has = set(new.columns)
    pick = lambda c: F.coalesce(f"_{c}", c) if c in overwrite and c in has else F.coalesce(c, f"_{c}") if (c in fill and c in has) else F.when(F.col(key).isNull(), F.col(f"_{c}")).otherwise(F.col(c)) if c in has else F.col(c)
    return j.select(F.coalesce(key, "_key").alias(key), *[pick(c).alias(c) for c in old.columns if c != key])


def delete_cascade(parent: DataFrame, key: str, gone: DataFrame, children: dict[str, tuple[DataFrame, str]], detached: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """Snapshots without the parents in `gone` (one column: keys) and without the children that refer to them; those in
    `detached` stay and refer to nothing."""
    ids = gone.toDF("_gone").distinct()
    drop = lambda d, c: d.join(ids, d[c] == ids["_gone"], "left_anti")
    free = lambda d, c: d.join(ids, d[c] == ids["_gone"], "left").withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).drop("_gone")
    return {"parent": drop(parent, key)} | {name: drop(d, c) for name, (d, c) in children.items()} | {name: free(d, c) for name, (d, c) in (detached or {}).items()}


def counted_up(counters: DataFrame, key: str, counter: str, events: DataFrame) -> DataFrame:
    """The counters with one more for every event of their key; keys without a counter begin at 0."""
    n = events.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    d = counters.join(n, F.col(key) == F.col("_key"), "full_outer")
    return d.select(F.coalesce(key, "_key").alias(key), (F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).alias(counter), *[c for c in counters.columns if c not in (key, counter)])


def assigned(df: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """A snapshot in which rows of the keys in `changes` have its values, null ones too; other rows and columns stay."""
    c = changes.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    d = df.join(c, F.col(key) == F.col("_key"), "left")
    return d.select(*[F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in changes.columns and x != key else F.col(x) for x in df.columns])


def plausible(new: DataFrame, old: DataFrame, share: float) -> DataFrame:
    """The new rows if there are at least `share` as many as old ones, else the old: one count of each side decides, within
    the plan."""
    n = new.agg(F.count("*").alias("_new")).crossJoin(old.agg(F.count("*").alias("_old"))).select((F.col("_new") >= share * F.col("_old")).alias("_ok"))  # a row each
    pick = lambda d, c: d.crossJoin(F.broadcast(n)).where(c).drop("_ok")
    return pick(new, F.col("_ok")).unionByName(pick(old, ~F.col("_ok")))
