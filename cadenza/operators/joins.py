"""As-of, interval, overlap, band and positional joins as equi-joins and windows, never as cross joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.folds import fold_groups


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, take: list[str], span: float | None = None, forward: bool = False) -> DataFrame:
    """left with `take` of the last right row of its keys at or before `at` (forward: the first one at or after).

    Both sides are dealt by keys once and each row sees the latest right row before it; with `span`, by keys and stretches
    of that length, so that a hot key (or none) spreads, and one row per stretch carries on what came before it. Of right
    rows at one time the greatest wins. Rows before all right ones get nulls.
    """
    pack = F.struct(F.col(right_at).alias("_t"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(take)])
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), pack.alias("_r"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in left.columns])
    l = left.select(*keys, F.col(at).cast(right.schema[right_at].dataType).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), *[F.col(c).alias(f"_l_{c}") for c in left.columns])
    both = r.unionByName(l)
    # In going order every right row comes before the left rows that may take it.
    order = [F.desc("_at"), F.col("_side"), F.desc("_r")] if forward else [F.col("_at"), F.col("_side"), F.col("_r")]
    seen = lambda w: F.last("_r", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if span is None:
        both = both.withColumn("_found", seen(W.partitionBy(*keys).orderBy(*order)))
    else:
        both = both.withColumn("_span", F.floor(F.col("_at").cast("double") / span))
        best = F.min if forward else F.max
        ends = both.groupBy(*keys, "_span").agg(best("_r").alias("_end"))
        by = W.partitionBy(*keys).orderBy(F.desc("_span") if forward else F.col("_span"))
        ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_span").alias("_s"), F.last("_end", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
        both = both.withColumn("_own", seen(W.partitionBy(*keys, "_span").orderBy(*order))).where("_side = 1")
        same = F.col("_span").eqNullSafe(F.col("_s"))
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        both = both.join(ends, same, "left").withColumn("_found", F.coalesce("_own", "_carried"))
    both = both.where("_side = 1")
    return both.select(*[F.col(f"_l_{c}").alias(c) for c in left.columns], *[F.col(f"_found._v{i}").alias(c) for i, c in enumerate(take)])


class Cells:
    """Cells of several widths: level l's are `width` 2 ** l wide, and an interval belongs to the first level whose cells are
    as wide as it is, so it touches two of them at most, however long it is. One without finite ends stands in a level of one
    cell. The number of levels follows from the longest interval, which a look at the data finds."""

    def __init__(self, sides: list[tuple[DataFrame, str, str]], width: float):
        self.width, longest, endless = float(width), 0.0, False
        for df, a, b in sides:
            n = F.col(b).cast("double") - F.col(a).cast("double")
            wild = F.isnan(n) | (F.abs(n) == float("inf"))
            most, any_ = df.agg(F.max(F.when(~wild, n)), F.max(wild)).first()
            longest, endless = max(longest, most or 0.0), endless or bool(any_)
        self.levels = max(0, math.ceil(math.log2(longest / self.width))) if longest > self.width else 0
        self.top = self.levels + endless

    def level(self, a: str, b: str) -> Column:
        n = F.col(b).cast("double") - F.col(a).cast("double")
        if not self.top:
            return F.lit(0)
        own = F.lit(0)
        for k in range(self.levels):  # the least level that is wide enough, without a logarithm's rounding
            own += (n > self.width * 2**k).cast("int")
        return F.when(F.isnan(n) | (F.abs(n) == float("inf")), self.top).otherwise(own)

    def at(self, level: Column, x: Column) -> Column:
        """The cell of a level that x is in."""
        if not self.top:
            return F.floor(x / self.width)
        return F.when(level > self.levels, F.lit(0).cast("long")).otherwise(F.floor(F.when(level <= self.levels, x / (self.width * F.pow(F.lit(2.0), level)))))

    def touched(self, a: str, b: str, level: Column) -> Column:
        """(level, cell) of each cell of a level that an interval touches."""
        return F.transform(F.sequence(self.at(level, F.col(a)), self.at(level, F.greatest(a, b))), lambda c: F.struct(level.alias("level"), c.alias("cell")))

    def upwards(self, a: str, b: str) -> Column:
        """(level, cell) of each cell of an interval's own level and of all above it."""
        if not self.top:
            return self.touched(a, b, F.lit(0))
        return F.flatten(F.transform(F.sequence(self.level(a, b), F.lit(self.top)), lambda l: self.touched(a, b, l)))


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: float, how: str = "inner", also: Column | None = None, ident: list[str] | None = None) -> DataFrame:
    """Pairs of rows of equal keys whose closed intervals meet. Either side is repeated for every cell (of `width`, and of
    Cells' greater widths for longer intervals) that it touches; a pair is kept in the cell of the greater start alone, at
    the greater of its levels. how: inner, left_semi or left_anti. Columns of the sides other than keys must differ in name;
    `also` is a further condition on a pair. Semi- and anti-joins tell left rows apart by `ident` (with keys; all columns if
    it isn't given), by value alone: a number made up while the plan runs may differ wherever it is computed again. Rows with
    a null end meet nothing."""
    left_, right = left, right.where(F.col(r[0]).isNotNull() & F.col(r[1]).isNotNull())
    left = left.where(F.col(l[0]).isNotNull() & F.col(l[1]).isNotNull())
    cells = Cells([(left, *l), (right, *r)], width)
    rk = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys], cells.level(*r).alias("_rl")).withColumn("_rc", F.explode(cells.upwards(*r)))
    lk = left.withColumn("_ll", cells.level(*l)).withColumn("_lc", F.explode(cells.upwards(*l)))
    cond = (F.col("_lc") == F.col("_rc")) & (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))
    if cells.top:
        cond &= F.col("_lc.level") == F.greatest("_ll", "_rl")
    for k in keys:
        cond &= F.col(k) == F.col(f"_r_{k}")
    if also is not None:
        cond &= also
    if how == "inner":
        cond &= F.col("_lc.cell") == cells.at(F.col("_lc.level"), F.greatest(l[0], r[0]))
        return lk.join(rk, cond).drop("_lc", "_rc", "_ll", "_rl", *[f"_r_{k}" for k in keys])
    hit = lk.join(rk, cond, "left_semi").drop("_lc", "_ll")
    if how == "left_semi" and ident:
        return hit.dropDuplicates([*keys, *ident])
    own = [*keys, *ident] if ident else left.columns
    return left_.join(*_same(hit.select(*own).distinct(), own), how)


def _same(values: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """values under other names, and the condition that `columns` equal those of the original names, null to null."""
    out = values.toDF(*[f"_h_{c}" for c in values.columns])
    cond = F.lit(True)
    for c in columns:
        cond &= F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return out, cond


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, r: tuple[str, str], take: list[str], width: float, ident: list[str] | None = None) -> DataFrame:
    """points with `take` of the interval that holds them; of several the one that starts last (then the greatest). Long
    intervals stand in wide cells (Cells); those with a null end hold nothing.
    Where none is longer than `width`, a cell's intervals are one row, the last one first, that each of its points looks
    through. Else, with ident, columns that tell the points apart, all is one join and one aggregate; without, what is
    found for each place is joined back by keys and place."""
    rk = intervals.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c).alias(f"_i_{c}") for c in dict.fromkeys([*r, *take])])
    ends = (f"_i_{r[0]}", f"_i_{r[1]}")
    rk = rk.where(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull())
    cells = Cells([(rk, *ends)], width)
    if not cells.top:
        last_first = F.sort_array(F.collect_list(F.struct(*[f"_i_{c}" for c in dict.fromkeys([r[0], *take, r[1]])])), asc=False)
        near = rk.withColumn("_rc", F.explode(cells.touched(*ends, F.lit(0)))).groupBy(*[f"_r_{k}" for k in keys], F.col("_rc.cell").alias("_rc")).agg(last_first.alias("_near"))
        cond = cells.at(F.lit(0), F.col(at)) == F.col("_rc")
        for k in keys:
            cond &= F.col(k) == F.col(f"_r_{k}")
        first = F.get(F.filter("_near", lambda x: (x[ends[0]] <= F.col(at)) & (F.col(at) <= x[ends[1]])), F.lit(0))
        d = points.join(near, cond, "left").withColumn("_best", first)
        return d.select(*points.columns, *[F.col(f"_best._i_{c}").alias(c) for c in take])
    rk = rk.withColumn("_rc", F.explode(cells.touched(*ends, cells.level(*ends))))
    p = points if ident else points.select(*keys, at).distinct()
    if cells.top:  # a point is in one cell of each level
        probed = p.withColumn("_pc", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cells.top)), lambda l: F.struct(l.alias("level"), cells.at(l, F.col(at)).alias("cell")))))
    else:
        probed = p.withColumn("_pc", F.struct(F.lit(0).alias("level"), cells.at(F.lit(0), F.col(at)).alias("cell")))
    cond = (F.col("_pc") == F.col("_rc")) & (F.col(f"_i_{r[0]}") <= F.col(at)) & (F.col(at) <= F.col(f"_i_{r[1]}"))
    for k in keys:
        cond &= F.col(k) == F.col(f"_r_{k}")
    own = ident or [*keys, at]
    best = F.max(F.when(F.col("_rc").isNotNull(), F.struct(*[F.col(f"_i_{c}") for c in (r[0], *take)]))).alias("_best")
    d = probed.join(rk, cond, "left").groupBy(*own).agg(best, *[F.first(c).alias(c) for c in p.columns if c not in own])
    found = [F.col(f"_best._i_{c}").alias(c) for c in take]
    if not ident:
        values, cond = _same(d.select(*own, "_best"), own)
        d = points.join(values, cond, "left").withColumnRenamed("_h__best", "_best")
    return d.select(*points.columns, *found)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, name: str = "distance") -> DataFrame:
    """left with the distance to the nearest right row of its keys: the lesser of one as-of join back and one ahead."""
    d = asof(left, right.select(*keys, F.col(right_at).alias("_before")), keys, at, "_before", ["_before"])
    d = asof(d, right.select(*keys, F.col(right_at).alias("_after")), keys, at, "_after", ["_after"], forward=True)
    return d.withColumn(name, F.least(F.col(at) - F.col("_before"), F.col("_after") - F.col(at))).drop("_before", "_after")


def count_until(grid: DataFrame, events: DataFrame, keys: list[str], at: str, event_at: str, name: str) -> DataFrame:
    """grid with how many events of its keys lie at or before `at`."""
    e = events.groupBy(*keys, event_at).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(W.partitionBy(*keys).orderBy(event_at))
    out = asof(grid, e.select(*keys, event_at, run.alias(name)), keys, at, event_at, [name])
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def events_within(spans: DataFrame, events: DataFrame, keys: list[str], ident: list[str], span: tuple[str, str], at: str) -> DataFrame:
    """keys, ident, first_event, last_event, n of the events after a span's begin and up to its end, of spans that have any;
    ident tells a key's spans apart. No event meets a span: at both bounds stands how many events came before, and which
    one is next to it."""
    none, kind = F.lit(None), events.schema[at].dataType
    e = events.dropna(subset=[*keys, at]).select(*keys, *[none.cast(spans.schema[c].dataType).alias(c) for c in ident], F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(at).alias("_e"))
    b = spans.dropna(subset=[*keys, *span]).select(*keys, *ident, F.explode(F.array(*[F.struct(F.col(c).alias("_at"), F.lit(i).alias("_side")) for i, c in enumerate(span, 1)])).alias("_b"))
    d = e.unionByName(b.select(*keys, *ident, "_b.*", none.cast(kind).alias("_e")))
    # events of a bound's time come before it
    so_far = W.partitionBy(*keys).orderBy("_at", F.col("_side") > 0).rowsBetween(W.unboundedPreceding, 0)
    to_come = W.partitionBy(*keys).orderBy(F.desc("_at"), F.desc(F.col("_side") > 0)).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"_n": F.count("_e").over(so_far), "_last": F.last("_e", ignorenulls=True).over(so_far)})
    d = d.withColumn("_first", F.last("_e", ignorenulls=True).over(to_come)).where("_side > 0")
    of = lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    d = d.groupBy(*keys, *ident).agg(of(1, "_first").alias("first_event"), of(2, "_last").alias("last_event"), (of(2, "_n") - of(1, "_n")).alias("n"))
    return d.where("n > 0")


def positional(results: DataFrame, array: Column, targets: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The elements of an array column with the target rows at their place; what has no counterpart is dropped."""
    d = results.withColumn("_items", array).select("*", F.posexplode("_items").alias(pos, "item")).drop("_items")
    return d.join(targets, [*keys, pos])


def greedy_overlap(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], l_id: str, r_id: str) -> DataFrame:
    """keys, l_id, r_id, overlap: every left row, in the order of its start, takes the unused right row that it overlaps
    most (ties: the least r_id). One group of keys is a page or a song: a bounded number of rows."""
    side = lambda d, i, i_id, ab: d.select(*keys, F.lit(i).alias("_side"), F.col(i_id).alias("_id"), F.col(ab[0]).cast("double").alias("_a"), F.col(ab[1]).cast("double").alias("_b"))
    both = side(left, 0, l_id, l).unionByName(side(right, 1, r_id, r))

    def match(rows: list[dict]) -> list[tuple]:
        free = sorted((x["_id"], x["_a"], x["_b"]) for x in rows if x["_side"])
        out = []
        for x in sorted((x for x in rows if not x["_side"]), key=lambda x: (x["_a"], x["_id"])):
            best = max(((min(x["_b"], d) - max(x["_a"], c), -k) for k, (_, c, d) in enumerate(free)), default=(0, 0))
            if best[0] > 0:
                out.append((x["_id"], free.pop(-best[1])[0], best[0]))
        return out

    return fold_groups(both, keys, ["_side", "_id", "_a", "_b"], f"{l_id} {dict(left.dtypes)[l_id]}, {r_id} {dict(right.dtypes)[r_id]}, overlap double", match)
