"""A note just at a rating's bound is rated by its exact accuracy, in whatever order its frames are summed."""

from itertools import accumulate, permutations

from cadenza.functions.scalars import FULL, NONE
from cadenza.operators import scoring as S
from cadenza.streaming.scoring import Scorer


def below_in_order():
    """Distances of eight frames whose credits are 5.5 in all, in orders in which the sum of floats is less."""
    credit = lambda d: 0.25 * (1.0 if d <= FULL else (NONE - d) / (NONE - FULL))
    found = sorted({p for p in permutations((0.0, 0.0, 0.0, 0.0, 1.5, 0.875, 1.375, 1.375)) if list(accumulate(map(credit, p)))[-1] / 2.5 < 0.55})
    return found[:: max(1, len(found) // 12)][:12]


def test_a_note_at_a_bound(spark):
    orders = below_in_order()
    assert len(orders) == 12
    frames = [(s, 1, 1.75 + 0.25 * i, m) for s, p in enumerate(orders) for i, m in enumerate([None, *(60.0 + d for d in p), None, None, None, None])]
    f = spark.createDataFrame(frames, "session_id long, song_id long, t double, midi double")
    n = spark.createDataFrame([(1, 0, 2.0, 4.5, 60)], "song_id long, pos int, t_start double, t_end double, midi int")
    got = S.note_results(f, n).collect()
    assert len(got) == 12 and {(r.acc, r.rating) for r in got} == {(0.55, 2)}


def test_the_stream_rates_alike():
    scorer = Scorer(False)
    scorer.rated = type("State", (), {"updateValue": lambda *_: None})()
    r = scorer.closed((1,), 0, [2.0, 4.5, 60.0, 1.3749999999999998, 0.0, 0.0], 4.75, {"combo": 0, "best": 0, "hit": 0.0, "dur": 0.0})
    assert (r.acc, r.rating) == (0.55, 2)
