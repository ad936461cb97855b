"""The scorer as a stream: frames of many sessions, state per session, rows as notes are closed and pages turned."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cadenza.functions.scalars import FULL, LOWEST_STAMP, NONE, RATINGS, STAMPS
from cadenza.operators.scoring import EXACT, LATE, LONGEST_FRAME, MEAN

RESULT = """session_id long, kind string, pos int, rating int, acc double, cents double, combo long, max_combo long, score double, stamp string,
trace array<struct<t:double,shown:double,credit:double>>"""
#: Fixed values, in seconds: how much of the trace is shown, how far beyond a page's end its last notes may reach.
SHOWN, BEYOND = 4.5, 0.2
#: Seconds for which frames wait for their session's start.
PATIENCE = 120.0
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Scorer(StatefulProcessor):
    """State of a session, each a variable of its own in the store: its open notes, its pages, the accuracy of rated notes
    that a page still waits for, frames that the watermark hasn't reached, a row of them for each batch, the trace's last
    seconds, and one row of sums. A timer stands at the next end of a note, LATE after it, or of a page.

    Frames are taken in the order of the song's clock once the watermark has passed them, so that the order in which they
    came doesn't show. A timer looks at where the song's clock is by then: a session that was held waits on. A call of the
    store costs more than the frames that it carries, so lists go as a whole, and nothing is read before something is due.
    """

    def __init__(self, trace: bool):
        self.with_trace, self.fields = trace, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.notes = handle.getListState("notes", "pos int, a double, b double, midi double, hit double, cents double, w double")
        self.pages = handle.getListState("pages", "section int, t0 double, t1 double")
        self.rated = handle.getListState("rated", "b double, acc double")
        self.frames = handle.getListState("frames", "t array<double>, ms array<long>, midi array<double>")
        self.trace = handle.getListState("trace", "t double, shown double, credit double")
        self.sums = handle.getValueState("sums", "origin double, t double, shown double, combo long, best long, hit double, dur double, due long, paged boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sums, started, notes, pages, frames = self.sums.get(), None, {}, {}, {}
        for r in rows:
            if self.fields is None:  # a row's names are looked up once
                self.fields = itemgetter(*map(r.__fields__.index, ("kind", "pos", "a", "b", "midi", "ms")))
            kind, pos, a, b, midi, ms = self.fields(r)
            if kind == "frame":
                if a is not None and ms is not None and not math.isnan(a):
                    self.heard(frames, a, ms, None if midi is None or math.isnan(midi) else midi)
            elif sums is None:
                started = ms / 1000 if started is None else min(started, ms / 1000)
                if None not in (pos, a, b) and (kind == "page" or midi is not None):
                    (notes if kind == "note" else pages)[pos] = (a, b, midi)
        if frames:
            self.frames.appendList([self.chunk(frames)])
        now, first = timerValues.getCurrentWatermarkInMs(), min((ms for ms, _ in frames.values()), default=None)
        if started is not None:
            yield from self.taken(key, now, (started, None, None, 0, 0, 0.0, 0.0, None, bool(pages)), {pos: [*n, 0.0, 0.0, 0.0] for pos, n in notes.items()}, {k: p[:2] for k, p in pages.items()})
        elif sums is None:
            if frames:
                self.handle.registerTimer(max(ms for ms, _ in frames.values()) + int(1000 * PATIENCE))
        elif min(x for x in (sums[7], first) if x is not None) <= now:
            yield from self.taken(key, now, sums)
        elif first is not None and first < sums[7]:
            self.sums.update((*sums[:7], first, sums[8]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, sums = timerValues.getCurrentWatermarkInMs(), self.sums.get()
        if sums is None:
            frames = self.held()
            if frames:
                self.keep({t: x for t, x in frames.items() if x[0] + 1000 * PATIENCE > now})
        elif sums[7] <= now:
            yield from self.taken(key, now, sums)

    @staticmethod
    def due(origin: float, t: float) -> int:
        """When the song's clock will be at t, in whole milliseconds, if it runs on."""
        return math.ceil(1000 * (origin + t)) + 1

    @staticmethod
    def heard(frames: dict, t: float, ms: int, midi: float | None) -> None:
        """Of frames at one time one without a pitch counts, else the lowest."""
        was = frames.get(t)
        if was is None or (midi is not None, midi or 0.0) < (was[1] is not None, was[1] or 0.0):
            frames[t] = (ms, midi)

    @staticmethod
    def chunk(frames: dict) -> tuple:
        return list(frames), [ms for ms, _ in frames.values()], [midi for _, midi in frames.values()]

    def held(self) -> dict:
        """Frames that wait, by time."""
        frames: dict = {}
        for own in self.frames.get():
            for t, ms, midi in zip(*own):
                self.heard(frames, t, ms, midi)
        return frames

    def keep(self, frames: dict) -> None:
        if frames:
            self.frames.put([self.chunk(frames)])
        else:
            self.frames.clear()

    def taken(self, key, now: int, sums: tuple, notes: dict | None = None, pages: dict | None = None) -> Iterator[Row]:
        """What frames up to the watermark, and the watermark itself, settle. notes and pages of a session that begins."""
        begins = notes is not None
        origin, last, shown, *totals, _, paged = sums
        s = dict(zip(("combo", "best", "hit", "dur"), totals))
        if not begins:
            notes = {pos: list(n) for pos, *n in self.notes.get()}
            pages = {section: x for section, *x in self.pages.get()} if paged else {}
        frames, trace, out, rated, waits, changed = self.held(), [], [], [], [], begins
        reached = sorted((t, *x) for t, x in frames.items() if x[0] <= now)

        def close(pos: int, t: float) -> None:
            n = notes.pop(pos)
            out.append(self.closed(key, pos, n, t, s))
            if out[-1].rating is not None:
                rated.append((n[1], out[-1].acc))

        for t, ms, midi in reached:
            del frames[t]
            dt, last = (0.0 if last is None else t - last), (t if last is None else max(last, t))
            origin = ms / 1000 - t
            if not 0 < dt < LONGEST_FRAME:
                continue
            on = max(((n[0], pos) for pos, n in notes.items() if n[0] <= t <= n[1]), default=None)
            if midi is not None:
                n = notes[on[1]] if on else None
                target = n[2] if n else midi if shown is None else shown
                shown, credit = midi + 12 * math.floor((target - midi) / 12 + 0.5), 0.0
                if n:
                    off = shown - n[2]
                    credit = 1.0 if abs(off) <= FULL else (NONE - abs(off)) / (NONE - FULL) if abs(off) <= NONE else 0.0
                    n[3] += dt * credit
                    if abs(off) <= NONE:
                        n[4] += off * 100 * dt
                        n[5] += dt
                    changed = True
                trace.append((t, shown, credit))
            for a, pos in sorted((n[0], pos) for pos, n in notes.items() if t > n[1]):
                close(pos, t)
        for pos, n in sorted(notes.items()):
            at = self.due(origin, n[1] + LATE)
            if at <= now:  # no frame can rate it any more
                close(pos, math.inf)
            else:
                waits.append(at)
        yield from out
        turned = []
        for section, (t0, t1) in sorted(pages.items(), key=lambda x: (x[1][1], x[0])):
            at = self.due(origin, t1 + BEYOND + LATE)
            if at > now:
                waits.append(at)
            else:
                turned.append((section, t0, t1))
                del pages[section]
        if turned:
            rated_all = [*self.rated.get(), *rated]
            for section, t0, t1 in turned:
                own = [acc for b, acc in rated_all if t0 < b <= t1 + BEYOND]
                if len(own) >= 2:
                    acc = round(sum(own) / len(own), MEAN)
                    yield self.row(key, "stamp", s, pos=section, acc=acc, stamp=next((x for least, x in STAMPS if acc >= least), LOWEST_STAMP))
        if trace and self.with_trace:
            trace = [x for x in [*map(tuple, self.trace.get()), *trace] if x[0] >= last - SHOWN]
            if trace:
                self.trace.put(trace)
                yield self.row(key, "trace", s, trace=[Row(t=t, shown=x, credit=c) for t, x, c in trace])
            else:
                self.trace.clear()
        if not notes and not pages:
            for state in (self.notes, self.frames, self.sums, *((self.pages, self.rated) if paged else ()), *((self.trace,) if self.with_trace else ())):
                state.clear()
            return
        if reached:
            self.keep(frames)
        if changed or out:
            if notes:
                self.notes.put([(pos, *n) for pos, n in notes.items()])
            else:
                self.notes.clear()
        if begins and pages or turned:
            if pages:
                self.pages.put([(section, *x) for section, x in pages.items()])
            else:
                self.pages.clear()
        if pages and rated:
            self.rated.appendList(rated)
        self.sums.update((origin, last, shown, s["combo"], s["best"], s["hit"], s["dur"], min([*waits, *(ms for ms, _ in frames.values())]), paged))
        self.handle.registerTimer(min(waits))  # the song's clock may have been held since the last one was set

    def closed(self, key, pos: int, n: list, t: float, s: dict) -> Row:
        late, dur, hit = t - n[1] > LATE, n[1] - n[0], round(n[3], EXACT)
        acc = 0.0 if late else min(1.0, hit / dur) if dur > 0 else 0.0
        rate = None if late else next((r for least, r in RATINGS if acc >= least), 0)
        if rate is not None:
            s["combo"] = s["combo"] + 1 if rate else 0
            s["best"] = max(s["best"], s["combo"])
            s["hit"] += min(hit, dur)
            s["dur"] += dur
        return self.row(key, "note", s, pos=pos, rating=rate, acc=acc, cents=n[4] / n[5] if n[5] else None)

    @staticmethod
    def row(key, kind: str, s: dict, pos=None, rating=None, acc=None, cents=None, stamp=None, trace=None) -> Row:
        score = 100 * (s["hit"] / s["dur"]) ** 0.7 if s["dur"] >= 0.5 else None
        return Row(session_id=key[0], kind=kind, pos=pos, rating=rating, acc=acc, cents=cents, combo=s["combo"], max_combo=s["best"], score=score, stamp=stamp, trace=trace)

    def close(self) -> None:
        pass


def score_stream(frames: DataFrame, starts: DataFrame, notes: DataFrame, flips: DataFrame | None = None, late: str = "10 seconds", trace: bool = False) -> DataFrame:
    """RESULT rows: of kind note for each note as it is closed, of kind stamp for each page of flips as it turns (pos is its
    section), with trace those of kind trace: the last SHOWN seconds, as often as frames are taken.

    frames: a stream of session_id, t (the song's clock), midi, at (when it came); starts: a stream of session_id, song_id,
    at (when the clock was at 0), a row for each session; notes: a table of song_id, pos, t_start, t_end, midi; flips: a
    table of song_id, section, t0, t1. A song's notes travel once for each start. Rows are those of operators.scoring's
    note_results and section_stamps, in whatever order frames come within the watermark, `late`; older ones are dropped,
    which Spark counts in its progress. A note that no frame passes is given out LATE after its end as not attempted
    (rating null, acc 0), so the state of a session that breaks off goes as well. A second start of a live session changes
    nothing; frames without a start go after PATIENCE. It sets the session's state store to RocksDB.
    """
    frames.sparkSession.conf.set(*STORE)
    at = F.col("at").cast("timestamp").alias("at")
    number = lambda c: F.col(c).cast("double")
    own = notes.select("song_id", F.lit("note").alias("kind"), F.col("pos").cast("int").alias("pos"), number("t_start").alias("a"), number("t_end").alias("b"), number("midi").alias("midi"))
    if flips is not None:
        pages = flips.select("song_id", F.lit("page").alias("kind"), F.col("section").cast("int").alias("pos"), number("t0").alias("a"), number("t1").alias("b"))
        own = own.unionByName(pages, allowMissingColumns=True)
    songs = starts.select(F.col("session_id").cast("long").alias("session_id"), "song_id", at).join(own, "song_id").drop("song_id")
    sung = frames.select(F.col("session_id").cast("long").alias("session_id"), F.lit("frame").alias("kind"), at, number("t").alias("a"), number("midi").alias("midi"))
    # one watermark for both, so that a stream in which nothing starts doesn't hold it back
    d = songs.unionByName(sung, allowMissingColumns=True).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return d.groupBy("session_id").transformWithState(Scorer(trace), RESULT, "Append", "eventTime")


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Plays per day and song of a stream; a day is given out when the watermark has passed it."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return d.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"))


def recent_requests(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests per user in sliding hours, every five minutes: a sign-in limit on a stream."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return d.groupBy(F.window("ts", "1 hour", "5 minutes"), "user_id").agg(F.count("*").alias("n"))
