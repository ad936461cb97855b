"""What a task holds at once, and fits of small groups, against the plain way."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tests_common import duckdb_of, rows_of

import __spark_entry__ as entry
from cadenza.functions.annotate import few
from cadenza.operators.robust import SMALL, circular_mode, line_through, theil_sen_line
from cadenza.operators.sweeps import confirmed_sweeps


def test_texts_come_a_few_at_a_time():
    texts = ["ab", None, "c" * 30, "", "d" * 4, "e" * 4]
    parts = list(few(pa.array(texts), 10))
    assert [t for p in parts for t in p] == texts and len(parts) > 2
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in parts)
    assert list(few(pa.array([], pa.string()), 10)) == []


def test_lines_through_few_points_are_those_of_arrays():
    rng = random.Random(3)
    for n in [*range(1, SMALL + 4)] * 8:
        points = sorted((rng.randrange(12) / 4, rng.uniform(0, 600)) for _ in range(n))
        assert line_through(points) == theil_sen_line(*np.array(points, float).reshape(-1, 2).T)
    assert line_through([]) is None and line_through([(1.0, 2.0), (1.0, 3.0)]) is None


def test_sweeps_are_walked_once(spark):
    rows = [(1, i, float(i % 10 * 100), float(i % 10 * 100 + 20), i * 0.5, i * 0.5 + 0.4) for i in range(600)] + [(1, 1000 + i, 0.0, 10.0, i * 7 + 3.6, i * 7 + 3.8) for i in range(40)]
    d = confirmed_sweeps(spark.createDataFrame(rows, "song_id int, pos int, x0 double, x1 double, t_start double, t_end double"), ["song_id"], "pos")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.pos: r.sweep for r in d.collect()}
    assert len(got) == 640 and max(got.values()) > 32 and all(got[i] == got[i - 1] for i in range(600) if i % 10 > 1)


def test_circular_modes_make_no_row_for_each_offset(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(178, 200) if rng.random() < 0.3 else rng.randrange(180)) for k in range(40) for _ in range(1 + k * 3)] + [(40, None), (40, 3), (41, 100), (41, 106), (42, 179), (42, 5)]
    d = circular_mode(spark.createDataFrame(rows, "k int, v int"), ["k"], "v")
    assert "Generate" not in d._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for key in range(43):
        values = [v % 180 for k, v in rows if k == key and v is not None]
        want[key] = max((sum((v - m + 6) % 180 <= 12 for v in values), -m) for m in range(180))
    got = {r.k: (r.weight, -r.mode if r.mode is not None else None) for r in d.collect()}
    assert got.pop(40) == (13, None) and want.pop(40) and got == want


def test_song_keys_make_no_row_for_each_base(spark):
    d = entry.queries()["song_keys"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(d) == rows_of(duckdb_of("/root/testdata/sf0.001").execute(entry.oracle_sql()["song_keys"]))


def test_notes_per_page_joins_nothing(spark):
    d = entry.queries()["notes_per_page"](spark, "/root/testdata/sf0.001")
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(d) == rows_of(duckdb_of("/root/testdata/sf0.001").execute(entry.oracle_sql()["notes_per_page"]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["note_results", "session_scores", "section_stamps", "session_ends", "note_energies"])
def test_songs_that_nobody_sings_go_first(spark, name):
    from cadenza.plans import registry

    lines = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    windows = [i for i, x in enumerate(lines) if "Window" in x and "l_orderkey" in x]
    for i in windows:  # below each window that numbers notes
        below = next((j for j in range(i + 1, len(lines)) if deep(lines[j]) <= deep(lines[i])), len(lines))
        assert any("LeftSemi" in x for x in lines[i + 1 : below])
    assert windows


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_extended_pages_are_not_joined(spark):
    from cadenza.plans import registry

    assert "Join" not in registry.QUERIES["extended_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_a_stream_does_not_number_its_notes_in_every_batch(spark, monkeypatch):
    from cadenza.plans import streams

    class Taken(Exception):
        pass

    def take(frames, starts, notes, late):
        raise Taken(notes._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(streams, "score_stream", take)
    with pytest.raises(Taken) as taken:
        streams.live_note_results(spark, "/root/testdata/sf0.001")
    assert "Window" not in str(taken.value) and "Relation" in str(taken.value)
