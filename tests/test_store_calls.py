"""How often the scorer asks the state store of a session: by batch, not by frame."""

from types import SimpleNamespace

from pyspark.sql import Row

from cadenza.streaming.scoring import Scorer


class State:
    """A state of one session in plain Python."""

    def __init__(self, kind):
        self.kind, self.rows, self.map, self.value = kind, [], {}, None

    def get(self):
        return self.value if self.kind == "value" else iter(list(self.rows))

    def exists(self):
        return self.value is not None

    def update(self, x):
        self.value = x

    def put(self, x):
        assert x  # the store takes no empty list
        self.rows[:] = x

    def appendList(self, x):
        self.rows.extend(x)

    def clear(self):
        self.rows.clear()
        self.map.clear()
        self.value = None

    def getValue(self, k):
        return self.map.get(k)

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        self.map.pop(k, None)

    def iterator(self):
        return iter(list(self.map.items()))

    def values(self):
        return iter(list(self.map.values()))


class Counted:
    """Something whose calls are counted."""

    def __init__(self, own, calls):
        self.own, self.calls = own, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.own, name)


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()
        for kind in ("value", "list", "map"):
            setattr(self, f"get{kind.title()}State", lambda *_, kind=kind: Counted(State(kind), self.calls))

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)


def run(trace):
    """A session of three notes and 300 frames in five batches; with a trace its last third is silent."""
    handle, scorer, now = Handle(), Scorer(trace), SimpleNamespace(getCurrentWatermarkInMs=lambda: clock[0])
    scorer.init(handle)
    row = lambda kind, **x: Row(**dict.fromkeys(("session_id", "pos", "a", "b", "midi", "t", "ms")) | {"kind": kind} | x)
    start = [row("note", pos=i, a=2.0 + 5 * i, b=4.0 + 5 * i, midi=60.0, ms=1000) for i in range(3)]
    frames = [row("frame", t=0.1 * i, a=0.1 * i, midi=None if trace and i >= 200 else 60.0, ms=1000 + 100 * i) for i in range(1, 301)]
    clock, out = [0], []
    for n in range(5):
        out += scorer.handleInputRows((1,), iter((start if n == 1 else []) + frames[n::5]), now)
    clock[0] = 10_000_000
    while handle.timers:
        handle.timers.remove(min(handle.timers))
        out += scorer.handleExpiredTimer((1,), now, None)
    return [(r.pos, r.rating, round(r.acc, 6)) for r in out if r.kind == "note"], len(handle.calls)


def test_calls_do_not_grow_with_frames():
    notes, calls = run(False)
    assert notes == [(0, 3, 1.0), (1, 3, 1.0), (2, 3, 1.0)]
    assert calls < 60


def test_a_trace_that_ends_in_silence():
    notes, calls = run(True)
    assert notes == [(0, 3, 1.0), (1, 3, 1.0), (2, 3, 1.0)] and calls < 60
