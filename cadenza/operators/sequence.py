"""Operators over ordered rows of a key: islands, streaks, runs, sessions, fills, trims and smoothing."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.folds import fold_groups


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Number the stretches of a key's rows; a row for which `new` holds begins one. `new` may use lag() over by(keys, order)."""
    d = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    return d.withColumn(name, F.sum("_new").over(by(keys, order).rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def by(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def day_streaks(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """keys, first, last, length of every run of consecutive days."""
    d = days.select(*keys, day).distinct()
    d = d.withColumn("_run", F.date_sub(day, F.row_number().over(by(keys, [day]))))
    return d.groupBy(*keys, "_run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("length")).drop("_run")


def current_and_longest(streaks: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """keys, streak (the run that ends today or yesterday, else 0), longest."""
    now = F.max(F.when(F.col("last") >= F.date_sub(today, 1), F.col("length")).otherwise(0))
    return streaks.where(F.col("last") <= today).groupBy(*keys).agg(now.alias("streak"), F.max("length").alias("longest"))


def local_day(ts: Column, tz_minutes: int) -> Column:
    """The day of a UTC time where local time is UTC less tz_minutes (the browser's sign)."""
    return F.to_date(ts - F.make_dt_interval(mins=F.lit(tz_minutes)))


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, least: int = 1) -> DataFrame:
    """Run-length encoding: keys, value, n, first and last `order` of every run of at least `least` equal values."""
    w = by(keys, order)
    d = islands(df, keys, order, ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull())
    o = order[0]
    d = d.groupBy(*keys, "island").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(o).alias(f"first_{o}"), F.max(o).alias(f"last_{o}"))
    return d.where(F.col("n") >= least).drop("island")


def settled_states(df: DataFrame, keys: list[str], order: list[str], cells: str, least: int = 3, changed: int = 3) -> DataFrame:
    """keys, cells, first_ and last_ of `order`'s first: states of a grid of cells (bits of a whole number, or bytes) that
    hold for `least` rows or more and differ in `changed` cells at least from the state taken before; the first one is
    taken. Runs are islands; of these alone each key's are folded in order, with one state in memory. A null is a state of
    no run, which ends the run before it."""
    o = order[0]
    held = runs(df, keys, order, cells, least).where(F.col(cells).isNotNull())
    number = lambda x: int.from_bytes(x, "big") if isinstance(x, (bytes, bytearray)) else x & (1 << 64) - 1

    def fold(rows: Iterable[dict]) -> Iterator[tuple]:
        taken = None
        for r in rows:
            now = number(r[cells])
            if taken is None or (now ^ taken).bit_count() >= changed:
                taken = now
                yield r[cells], r[f"first_{o}"], r[f"last_{o}"]

    kinds = dict(held.dtypes)
    columns = [cells, f"first_{o}", f"last_{o}"]
    return fold_groups(held, keys, columns, ", ".join(f"{c} {kinds[c]}" for c in columns), fold, order=[f"first_{o}"])


def gap_sessions(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """keys, start, end, n: rows chained while each is at most `gap` after the one before."""
    w = by(keys, [at])
    d = islands(df, keys, [at], F.col(at) - F.lag(at).over(w) > gap)
    return d.groupBy(*keys, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("island")


def anchored_sessions(df: DataFrame, keys: list[str], at: str, width: float, least: int = 1, apart: float = 0.0) -> DataFrame:
    """keys, at, n: the first window of `width` from a row's place that holds `least` rows, at its last row's place; then
    the first one after it, and so on. Where a window holds fewer, the next begins at the next place. Of two less than
    `apart` from each other the later one stays. This goes row by row, but only between gaps that no window and no
    comparison reaches over, with one window in memory."""

    def fold(rows: Iterable[dict]) -> Iterator[tuple]:
        kept: tuple | None = None
        for end, n in windows(rows):
            if kept and end - kept[0] >= apart:
                yield kept
            kept = (end, n)
        if kept:
            yield kept

    def windows(rows: Iterable[dict]) -> Iterator[tuple]:
        held: deque[list] = deque()  # places, each with its rows

        def settle(upto: float | None) -> Iterator[tuple]:
            """What the windows say that end before the place `upto` (None: all)."""
            while held and (upto is None or upto - held[0][0] > width):
                if sum(n for _, n in held) >= least:
                    yield held[-1][0], sum(n for _, n in held)
                    held.clear()
                else:
                    held.popleft()

        for r in rows:
            x = r[at]
            if held and held[-1][0] == x:
                held[-1][1] += 1
                continue
            yield from settle(x)
            held.append([x, 1])
        yield from settle(None)

    d = df.where(F.col(at).isNotNull()).select(*keys, at)
    d = islands(d, keys, [at], F.col(at) - F.lag(at).over(by(keys, [at])) > max(width, apart), "_island")
    return fold_groups(d, [*keys, "_island"], [at], f"{at} {dict(df.dtypes)[at]}, n long", fold, order=[at]).drop("_island")


def refractory_edges(df: DataFrame, keys: list[str], frame: str, hot: Column, gap: int) -> DataFrame:
    """Rows that are hot, the first of every stretch whose hot rows are at most `gap` apart."""
    d = df.where(hot)
    before = F.lag(frame).over(by(keys, [frame]))
    return d.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(frame) - F.col("_before") > gap)).drop("_before")


def trim_to_next(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, before: float = 0.01, least: float = 0.05) -> DataFrame:
    """Ends no later than `before` the next start, but `least` after their own start."""
    nxt = F.lead(start).over(by(keys, order))
    return df.withColumn(end, F.when(nxt.isNotNull() & (F.col(end) > nxt - before), F.greatest(nxt - before, F.col(start) + least)).otherwise(F.col(end)))


def fill_ends(df: DataFrame, keys: list[str], order: list[str], start: str, last: Column, name: str = "t_end") -> DataFrame:
    """Every row ends where the next begins, the last one at `last`."""
    return df.withColumn(name, F.coalesce(F.lead(start).over(by(keys, order)), last))


def fill_periods(df: DataFrame, keys: list[str], at: str, period: float, slack: float = 0.25, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """keys, at, filled: rows added wherever the next one is a whole number of periods away (up to slack of a period).
    With start, rows are also added before a key's first one until one is at start or before it; with end, after the last
    one as long as they are before end. Both are of a key's rows alike."""
    nxt = F.lead(at).over(by(keys, [at]))
    k = F.round((nxt - F.col(at)) / period)
    ok = (k >= 2) & (F.abs((nxt - F.col(at)) / k - period) <= slack * period)
    none = F.lit(0)
    front = none if start is None else F.when(F.lag(at).over(by(keys, [at])).isNull() & (F.col(at) > start), F.ceil((F.col(at) - start) / period).cast("int")).otherwise(none)
    back = none if end is None else F.when(nxt.isNull() & (F.col(at) + period < end), F.ceil((end - F.col(at)) / period).cast("int") - 1).otherwise(none)
    steps = F.sequence(-front, F.when(ok, k.cast("int") - 1).otherwise(back))
    d = df.withColumns({"_step": F.when(ok, (nxt - F.col(at)) / k), "_steps": steps}).select(*keys, at, "_step", F.explode("_steps").alias("_i"))
    step = F.when(F.col("_i") < 0, F.lit(period)).otherwise(F.coalesce("_step", F.lit(period)))
    return d.select(*keys, (F.col(at) + step * F.col("_i")).alias(at), (F.col("_i") != 0).alias("filled"))


def rolling_median(df: DataFrame, keys: list[str], order: list[str], value: str, half: int = 4, least: int = 3, name: str = "smooth") -> DataFrame:
    """The median of the non-null values within `half` rows either way, null if there are fewer than `least`."""
    near = F.sort_array(F.collect_list(value).over(by(keys, order).rowsBetween(-half, half)))
    n = F.size("_near")
    mid = (F.get("_near", ((n - 1) / 2).cast("int")) + F.get("_near", (n / 2).cast("int"))) / 2
    return df.withColumn("_near", near).withColumn(name, F.when(n >= least, mid)).drop("_near")


def interpolate(df: DataFrame, keys: list[str], at: str, value: str, most: float, name: str = "filled", slopes: tuple[float, float] | None = None) -> DataFrame:
    """Nulls between two values at most `most` apart lie on the line between them, if its slope is in `slopes` (from the
    first, below the second)."""
    w = by(keys, [at])
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    d = df.withColumns({"_a": F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_b": F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(at) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    rise, run = F.col("_b.v") - F.col("_a.v"), F.col("_b.t") - F.col("_a.t")
    joined = (run <= most) & (F.lit(True) if slopes is None else (rise >= slopes[0] * run) & (rise < slopes[1] * run))
    return d.withColumn(name, F.coalesce(value, F.when(joined, line))).drop("_a", "_b")


def crossings(df: DataFrame, keys: list[str], order: list[str], value: str, level: Column) -> DataFrame:
    """Rows at which the value goes from below the level to it or above."""
    before = F.lag(value).over(by(keys, order))
    return df.withColumn("_before", before).where((F.col("_before") < level) & (F.col(value) >= level)).drop("_before")


def ema(values: Column, keep: float = 0.7) -> Column:
    """The exponential mean of an array in its order: keep times the mean so far and the rest of the next value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.lit(1), F.size(values))), F.get(values, 0).cast("double"), lambda a, x: keep * a + (1 - keep) * x)


def combos(df: DataFrame, keys: list[str], order: list[str], hit: Column, name: str = "combo") -> DataFrame:
    """How many rows up to this one were hits without a miss; nulls neither count nor break it."""
    w = by(keys, order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumns({"_hit": hit.cast("int")}).withColumn("_miss", F.sum(F.when(F.col("_hit") == 0, 1).otherwise(0)).over(w))
    run = W.partitionBy(*keys, "_miss").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn(name, F.sum(F.coalesce("_hit", F.lit(0))).over(run)).drop("_hit", "_miss")


def segments(df: DataFrame, keys: list[str], at: str, x: str, drop: float = 60.0, gap: float = 0.7) -> DataFrame:
    """Number the sweeps: a new one where x falls by more than `drop` or time stands still for more than `gap`."""
    w = by(keys, [at])
    return islands(df, keys, [at], (F.lag(x).over(w) - F.col(x) > drop) | (F.col(at) - F.lag(at).over(w) > gap), "segment")


def spine(df: DataFrame, keys: list[str], day: str, n: str, first: Column, last: Column) -> DataFrame:
    """A row for every key and day from first to last, with n or 0, and its level (0, 1 to 2, 3 to 5, 6 or more)."""
    days = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(first, last)).alias(day))
    d = days.join(df.select(*keys, day, n), [*keys, day], "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return d.withColumn("level", F.when(F.col(n) >= 6, 3).when(F.col(n) >= 3, 2).when(F.col(n) >= 1, 1).otherwise(0))


def _micro(at: str) -> Column:
    """A time in millionths, as ranges of windows need whole numbers."""
    return F.round(F.col(at) * 1e6).cast("long")


def page_splits(df: DataFrame, keys: list[str], at: str, x: str, gap: float, back: float, stay: float, hold: float, marks: DataFrame | None = None, name: str = "page") -> DataFrame:
    """Number the pages of a trace: a new one after a gap, where x falls by more than `back` and what follows within `hold`
    stays more than `stay` below, and at the first row after a known time (marks: keys and `mark`)."""
    w = by(keys, [at])
    ahead = W.partitionBy(*keys).orderBy(_micro(at)).rangeBetween(0, round(1e6 * hold))
    before = F.lag(x).over(w)
    new = (F.col(at) - F.lag(at).over(w) > gap) | ((before - F.col(x) > back) & (F.max(x).over(ahead) < before - stay))
    if marks is not None:
        rows = df.select(*keys, F.col(at).alias("_t"), F.lit(False).alias("_mark")).unionByName(marks.select(*keys, F.col("mark").alias("_t"), F.lit(True).alias("_mark")))
        # a mark comes before a row of its time
        seen = F.lag("_mark").over(W.partitionBy(*keys).orderBy("_t", F.desc("_mark")))
        first = rows.withColumn("_after", F.coalesce(seen, F.lit(False))).where("NOT _mark AND _after").select(*keys, F.col("_t").alias(at), F.lit(True).alias("_after")).distinct()
        df = df.join(first, [*keys, at], "left")
        new = new | F.coalesce("_after", F.lit(False))
    return islands(df, keys, [at], new, name).drop("_after")


def reject_outliers(df: DataFrame, keys: list[str], at: str, x: str, half: float, within: float, name: str = "cleaned") -> DataFrame:
    """x where it lies within `within` of the robust line through the rows up to `half` away in time (the median slope of
    their pairs, then the median rest), else null; where two rows or fewer are near, as it is."""
    near = F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(x).cast("double").alias("x"))).over(W.partitionBy(*keys).orderBy(_micro(at)).rangeBetween(-round(1e6 * half), round(1e6 * half)))
    mid = lambda a: (F.get(a, ((F.size(a) - 1) / 2).cast("int")) + F.get(a, (F.size(a) / 2).cast("int"))) / 2
    d = df.withColumn("_p", F.when(F.col(x).isNotNull(), F.filter(near, lambda p: p["x"].isNotNull())))
    pairs = F.flatten(F.transform("_p", lambda p: F.transform(F.filter(F.col("_p"), lambda q: q["t"] > p["t"]), lambda q: (q["x"] - p["x"]) / (q["t"] - p["t"]))))
    d = d.withColumn("_s", F.sort_array(pairs)).withColumn("_slope", mid(F.col("_s")))
    d = d.withColumn("_r", F.sort_array(F.transform("_p", lambda p: p["x"] - F.col("_slope") * p["t"])))
    far = F.abs(F.col(x) - F.col("_slope") * F.col(at) - mid(F.col("_r"))) > within
    return d.withColumn(name, F.when((F.size("_p") > 2) & far, None).otherwise(F.col(x))).drop("_p", "_s", "_slope", "_r")


def arrivals(df: DataFrame, keys: list[str], order: str, value: str, level: Column, step: float = 60.0, fall: float = 200.0, born: float = 45.0) -> DataFrame:
    """Rows at which the value reaches the level: it rises over it by less than `step`, or, after a gap or a fall of more
    than `fall`, begins within `born` above it."""
    before = F.lag(value).over(by(keys, [order]))
    d = df.withColumn("_before", before)
    up = (F.col("_before") < level) & (F.col(value) >= level) & (F.col(value) - F.col("_before") < step)
    anew = (F.col("_before").isNull() | (F.col("_before") - F.col(value) > fall)) & (F.col(value) >= level) & (F.col(value) <= level + born)
    return d.where(up | anew).drop("_before")
