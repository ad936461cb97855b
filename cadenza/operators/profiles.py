"""Runs in profiles: arrays of a frame's columns, searched with higher-order functions, a row staying a row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of a playhead: columns that it is wide at most, columns from the left edge, columns beyond either side at
#: which it has to be quiet. Of touching bars: rows by which their middles part, columns that a bar has at least.
WIDEST, EDGE, BEYOND, JUMP, LEAST = 14, 3, 8, 3.0, 3


def _places(profile: Column) -> Column:
    """0 .. size - 1; empty for an empty or null array."""
    return F.when(F.size(profile) > 0, F.sequence(F.lit(0), F.size(profile) - 1)).otherwise(F.array().cast("array<int>"))


def runs(profile: Column, inside, breaks=None) -> Column:
    """Array of (a, b), the first and the last place of every maximal run of elements for which inside(element) holds; a run
    is cut between two elements for which breaks(left, right) does. Null elements are in no run."""
    at = lambda i: F.get(profile, i)
    holds = lambda i: (i >= 0) & (i < F.size(profile)) & F.coalesce(inside(at(i)), F.lit(False))
    cut = (lambda i: F.coalesce(breaks(at(i), at(i + 1)), F.lit(False))) if breaks else (lambda i: F.lit(False))
    first = F.filter(_places(profile), lambda i: holds(i) & (~holds(i - 1) | cut(i - 1)))
    last = F.filter(_places(profile), lambda i: holds(i) & (~holds(i + 1) | cut(i)))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def isolated_peaks(profile: Column, height: float, quiet: float, widest: int = WIDEST, edge: int = EDGE, beyond: int = BEYOND) -> Column:
    """Array of (x, width) of the runs of at least `height` that are at most `widest` wide, begin `edge` or more from the
    left, and have at most `quiet` at `beyond` places from either end (or at the profile's own end)."""
    n = F.size(profile)
    alone = lambda r: (r["b"] - r["a"] + 1 <= widest) & (r["a"] >= edge) & (F.coalesce(F.get(profile, F.greatest(F.lit(0), r["a"] - beyond)), F.lit(0.0)) <= quiet) & (F.coalesce(F.get(profile, F.least(n - 1, r["b"] + beyond)), F.lit(0.0)) <= quiet)
    found = F.filter(runs(profile, lambda x: x >= height), alone)
    return F.transform(found, lambda r: F.struct(F.floor((r["a"] + r["b"]) / 2).cast("int").alias("x"), (r["b"] - r["a"] + 1).alias("width")))


def column_middles(mask: Column) -> Column:
    """Of a mask (an array of rows, arrays of 0 and 1) the mean row of each column's ones; null where it has none."""
    width = F.size(F.get(mask, F.lit(0)))
    one = lambda y, x: F.coalesce(F.get(F.get(mask, y), x), F.lit(0))
    rows = _places(mask)
    total = lambda x, f: F.aggregate(rows, F.lit(0.0), lambda s, y: s + f(y) * one(y, x))
    count = lambda x: total(x, lambda y: F.lit(1.0))
    return F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), lambda x: F.when(count(x) > 0, total(x, lambda y: y.cast("double")) / count(x)))


def split_bars(middles: Column, jump: float = JUMP, least: int = LEAST) -> Column:
    """Array of (x0, x1, middle) of the bars in a blob: columns whose middles are within `jump` of the one before, `least`
    of them or more; x1 is the first column beyond; middle the mean."""
    found = F.filter(runs(middles, lambda x: x.isNotNull(), lambda a, b: F.abs(b - a) > jump), lambda r: r["b"] - r["a"] + 1 >= least)
    n = lambda r: r["b"] - r["a"] + 1
    return F.transform(found, lambda r: F.struct(r["a"].alias("x0"), (r["b"] + 1).alias("x1"), (F.aggregate(F.slice(middles, r["a"] + 1, n(r)), F.lit(0.0), lambda s, x: s + x) / n(r)).alias("middle")))
