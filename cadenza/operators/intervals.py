"""Overlapping intervals and bars: partition, duplicates, clusters and tracks.

The folds depend on the order of their rows and take one song or page at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from cadenza.operators.folds import fold_groups

#: Fixed values, in seconds: pieces shorter than SLIVER own nothing, notes shorter than SHORTEST go, a note lies within
#: another one up to WITHIN at either end.
SLIVER, SHORTEST, WITHIN = 0.02, 0.035, 0.02


def last_wins(df: DataFrame, keys: list[str], ident: str, start: str = "t_start", end: str = "t_end", sliver: float = SLIVER, least: float = SHORTEST) -> DataFrame:
    """keys, ident, start, end: no two overlap. Every moment between two neighbouring bounds belongs to the interval that
    started last (of equal starts the one that ends first, then the least ident); pieces shorter than `sliver`
    belong to nobody, pieces of one interval at most `least` apart are one again, and what is shorter than `least` goes.
    Intervals stream in the order of their starts; those that are open are in memory."""
    kind = df.select(F.coalesce(start, end).alias("_")).dtypes[0][1]
    d = df.where(F.col(end) > F.col(start)).dropna(subset=keys).select(*keys, ident, F.col(start).cast(kind).alias("_a"), F.col(end).cast(kind).alias("_b"))

    def pieces(rows: Iterable[dict]) -> Iterator[tuple]:
        """ident and bounds of what is owned between two neighbouring bounds, in order."""
        ends: list = []  # bounds to come, a heap
        live: list[tuple] = []  # ends, starts and idents; an earlier one ends later, the last one owns
        at = None

        def upto(x) -> Iterator[tuple]:
            middle = (at + x) / 2
            while live and live[-1][0] < middle:
                live.pop()
            if live and x - at >= sliver - 1e-9 and live[-1][1] <= middle and live[-1][2] is not None:
                yield live[-1][2], at, x

        for a, same in groupby(rows, lambda r: r["_a"]):
            while ends and ends[0] <= a:
                x = heapq.heappop(ends)
                if x > at:
                    yield from upto(x)
                    at = x
            if at is not None and a > at:
                yield from upto(a)
            at = a
            for r in reversed(list(same)):  # of equal starts the one that ends first comes out on top
                b = math.inf if r["_b"] != r["_b"] else r["_b"]
                heapq.heappush(ends, b)
                while live and live[-1][0] <= b:
                    live.pop()
                live.append((b, a, r[ident]))
        while ends:
            x = heapq.heappop(ends)
            if x > at:
                yield from upto(x)
                at = x

    def fold(rows: Iterable[dict]) -> Iterator[tuple]:
        own = None
        for i, s, e in pieces(rows):
            if own and own[0] == i and s - own[2] <= least + 1e-6:
                own = i, own[1], e
                continue
            if own and own[2] - own[1] >= least:
                yield own
            own = i, s, e
        if own and own[2] - own[1] >= least:
            yield own

    return fold_groups(d, keys, [ident, "_a", "_b"], f"{ident} {dict(df.dtypes)[ident]}, {start} {kind}, {end} {kind}", fold, order=["_a", "_b", ident])


def shadowed(df: DataFrame, keys: list[str], ident: str, kept: DataFrame) -> DataFrame:
    """The intervals of which last_wins left nothing, with the reason for an audit log."""
    return df.join(kept.select(*keys, ident).distinct(), [*keys, ident], "left_anti").withColumn("reason", F.lit("shadowed"))


def undo_splits(df: DataFrame, keys: list[str], exact: list[str], start: str, end: str) -> DataFrame:
    """Rows equal in `exact` become one that spans them; null equals null."""
    return df.groupBy(*keys, *exact).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"))


def drop_contained(df: DataFrame, keys: list[str], ident: str, pitch: str, start: str, end: str, slack: float = WITHIN) -> DataFrame:
    """keys, pitch, ident, start, end of what isn't contained, up to slack at either end, in a kept interval of one pitch that comes
    before it in the order of start, end and ident. All that a pitch needs to remember is the last end that it kept."""

    def fold(rows: Iterable[dict]) -> Iterator[tuple]:
        reached = float("-inf")
        for r in rows:
            if r[end] - slack > reached:
                reached = max(reached, r[end])
                yield r[ident], r[start], r[end]

    kinds = dict(df.dtypes)
    return fold_groups(df, [*keys, pitch], [ident, start, end], ", ".join(f"{c} {kinds[c]}" for c in (ident, start, end)), fold, order=[start, end, ident])


class Spans:
    """Intervals found by where they lie: each stands in the one or two cells, as wide as a power of two, that it touches."""

    def __init__(self):
        self.levels: dict[int, dict[int, list[tuple[float, float]]]] = {}

    def add(self, a: float, b: float) -> None:
        level = max(-40, math.frexp(b - a)[1])
        cells = self.levels.setdefault(level, {})
        for c in {math.floor(math.ldexp(a, -level)), math.floor(math.ldexp(b, -level))}:
            cells.setdefault(c, []).append((a, b))

    def near(self, a: float, b: float) -> Iterator[tuple[float, float]]:
        """Those that may meet a..b, some of them twice."""
        for level, cells in self.levels.items():
            first, last = math.floor(math.ldexp(a, -level)), math.floor(math.ldexp(b, -level))
            if last - first < len(cells):
                for c in range(first, last + 1):
                    yield from cells.get(c, ())
            else:
                for c, own in cells.items():
                    if first <= c <= last:
                        yield from own


def suppress_overlaps(df: DataFrame, keys: list[str], ident: str, prefer: list[tuple[str, bool]], start: str, end: str, share: float = 0.3) -> DataFrame:
    """keys, ident of the rows that, taken in order of preference (column, descending; then ident), overlap none taken before
    by more than `share` of the lesser width. Rows stream in that order; in memory are the ends of those taken, which a row
    finds by where they lie. Rows without ends are left out."""

    def fold(rows: Iterable[dict]) -> Iterator[tuple]:
        taken = Spans()
        for r in rows:
            a, b = float(r[start]), float(r[end])
            if all(min(b, v) - max(a, u) <= share * min(b - a, v - u) for u, v in taken.near(a, b)):
                taken.add(a, b)
                yield (r[ident],)

    order = [F.desc(c) if down else F.asc(c) for c, down in prefer]
    d = df.where(F.col(end) >= F.col(start))
    return fold_groups(d, keys, [ident, start, end, *(c for c, _ in prefer)], f"{ident} {dict(df.dtypes)[ident]}", fold, order=[*order, F.asc(ident)])


def cluster_bars(df: DataFrame, keys: list[str], order: list[str], dy: float = 4.0, d0: float = 6.0, d1: float = 8.0) -> DataFrame:
    """keys, cluster, x0, x1, cy, seen: every bar (x0, x1, cy), in order, joins the first cluster that it is near enough:
    to its leftmost x0, its rightmost x1 and the cy that it began with. Bars stream; in memory are the clusters, which a bar
    finds by a grid of cells dy high and d0 wide. Bars without a place are left out."""

    def fold(rows: Iterable[dict]) -> Iterator[tuple]:
        found: list[list] = []
        grid: dict[tuple[int, int], set[int]] = {}
        cell = lambda y, x: (math.floor(y / dy), math.floor(x / d0))
        for r in rows:
            x0, x1, cy = float(r["x0"]), float(r["x1"]), float(r["cy"])
            v, u = cell(cy, x0)
            near = [i for a in (v - 1, v, v + 1) for b in (u - 1, u, u + 1) for i in grid.get((a, b), ())]
            near = [i for i in near if abs(cy - found[i][2]) < dy and abs(x0 - found[i][0]) <= d0 and abs(x1 - found[i][1]) <= d1]
            if not near:
                grid.setdefault((v, u), set()).add(len(found))
                found.append([x0, x1, cy, 1])
                continue
            i = min(near)
            box = found[i]
            if x0 < box[0] and cell(box[2], box[0]) != cell(box[2], x0):
                grid[cell(box[2], box[0])].discard(i)
                grid.setdefault(cell(box[2], x0), set()).add(i)
            box[0], box[1], box[3] = min(box[0], x0), max(box[1], x1), box[3] + 1
        for i, c in enumerate(found):
            yield i, *c

    d = df.dropna(subset=["x0", "x1", "cy"])
    return fold_groups(d, keys, [*order, "x0", "x1", "cy"], "cluster int, x0 double, x1 double, cy double, seen long", fold, order=order)


def grow_tracks(df: DataFrame, keys: list[str], frame: str, step: int = 1, dy: float = 5.0, dx: float = 7.0, back: float = 8.0) -> DataFrame:
    """keys, track, first_f, last_f, x0, x1, cy, h, first_w, hits: detections (x0, x1, cy, h), in the order of frames,
    continue the oldest open track at their place, last seen at most 4 steps ago, unless they end more than `back` left of
    it (the bar is being drawn anew); a track closes when it hasn't been seen for more than 5 steps. Rows stream: open
    tracks alone are in memory."""

    def fold(rows: Iterable[dict]) -> Iterator[tuple]:
        live: list[dict] = []
        begun = 0
        for r in rows:
            f = r[frame]
            yield from (shown(t) for t in live if f - t["last"] > 5 * step)
            live = [t for t in live if f - t["last"] <= 5 * step]
            same = next((t for t in live if abs(t["cy"] - r["cy"]) <= dy and abs(t["x0"] - r["x0"]) <= dx and f - t["last"] <= 4 * step and r["x1"] >= t["x1"] - back), None)
            if same is None:
                live.append({"n": begun, "first": f, "last": f, "x0": r["x0"], "x1": r["x1"], "cy": float(r["cy"]), "h": r["h"], "w": r["x1"] - r["x0"], "hits": 1})
                begun += 1
            else:
                same |= {"last": f, "x0": min(same["x0"], r["x0"]), "x1": max(same["x1"], r["x1"]), "cy": 0.7 * same["cy"] + 0.3 * r["cy"], "h": max(same["h"], r["h"]), "hits": same["hits"] + 1}
        yield from map(shown, live)

    def shown(t: dict) -> tuple:
        return t["n"], t["first"], t["last"], float(t["x0"]), float(t["x1"]), t["cy"], float(t["h"]), float(t["w"]), t["hits"]

    return fold_groups(df, keys, [frame, "x0", "x1", "cy", "h"], "track int, first_f long, last_f long, x0 double, x1 double, cy double, h double, first_w double, hits long", fold, order=[frame, "cy", "x0", "x1", "h"])


def track(df: DataFrame, keys: list[str], frame: str, dy: float = 12.0, gap: int = 20, overlap: float = 0.5) -> DataFrame:
    """keys, track, first_f, last_f, x0, x1, cy, hits: detections in the order of frames join the live track of nearly
    their height that they overlap most (more than `overlap` of the lesser width); a track closes after `gap` frames."""

    def fold(rows: list[dict]) -> list[tuple]:
        live: list[dict] = []
        done: list[dict] = []
        for r in sorted(rows, key=lambda r: (r[frame], r["cy"], r["x0"])):
            done += [t for t in live if r[frame] - t["last"] > gap]
            live = [t for t in live if r[frame] - t["last"] <= gap]
            best, most = None, 0.0
            for t in live:
                both = min(r["x1"], t["x1"]) - max(r["x0"], t["x0"])
                if abs(r["cy"] - t["cy"]) < dy and both > overlap * min(r["x1"] - r["x0"], t["x1"] - t["x0"]) and both > most:
                    best, most = t, both
            if best is None:
                live.append({"first": r[frame], "last": r[frame], "x0": r["x0"], "x1": r["x1"], "cy": float(r["cy"]), "hits": 1})
            else:
                best |= {"last": r[frame], "x1": max(best["x1"], r["x1"]), "cy": 0.7 * best["cy"] + 0.3 * r["cy"], "hits": best["hits"] + 1}
        return [(i, t["first"], t["last"], float(t["x0"]), float(t["x1"]), t["cy"], t["hits"]) for i, t in enumerate(sorted(done + live, key=lambda t: (t["first"], t["cy"], t["x0"])))]

    return fold_groups(df, keys, [frame, "x0", "x1", "cy"], "track int, first_f long, last_f long, x0 double, x1 double, cy double, hits long", fold)
