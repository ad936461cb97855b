"""Sound read by ranges: rows are those of one range, whatever the stretches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import audio
from cadenza.sources.sound import SoundReader, read_sound, write_sound


@pytest.fixture
def folder(tmp_path):
    rng = np.random.RandomState(1)
    for name, n in (("a", 30_000), ("b", 8192), ("short", 100), ("none", 0)):
        (tmp_path / f"{name}.f32").write_bytes(rng.randn(n).astype("<f4").tobytes() + (b"xyz" if name == "a" else b""))
    (tmp_path / "other.txt").write_text("no sound")
    return tmp_path


def direct(path, window, hop, measure, rate=22050.0):
    raw = path.read_bytes()
    x = np.frombuffer(raw[: len(raw) // 4 * 4], "<f4")
    rows = [x[a : a + window] for a in range(0, len(x) - window + 1, hop)]
    return measure(window, rate)(np.array(rows)) if rows else []


@pytest.mark.parametrize("stretch", [1, 4096 * 3, 64_000_000])
def test_stretches_don_t_show(spark, folder, stretch):
    for name, measure in (("semitones", audio.semitones), ("loudness", audio.loudness)):
        d = read_sound(spark, f"file://{folder}", measure=name, stretch=stretch, hop=1024)
        got = {(os.path.basename(r.path)[:-4], r.frame): (r.t, r.measured) for r in d.collect()}
        want = {(p, k): v for p in ("a", "b", "short", "none") for k, v in enumerate(direct(folder / f"{p}.f32", 8192, 1024, measure))}
        assert got.keys() == want.keys() and len(got) == 23
        assert all(np.allclose(got[k][1], want[k], rtol=1e-4, atol=1e-4) and got[k][0] == k[1] * 1024 / 22050 for k in want)


def test_whole_files_have_the_same_energies(spark, folder):
    files = spark.read.format("binaryFile").load(f"{folder}/*.f32")
    want = {(r.path.rsplit("/", 1)[1], r.frame): r.energy for r in audio.semitone_energies(files).collect()}
    got = {(r.path.rsplit("/", 1)[1], r.frame): r.measured for r in read_sound(spark, f"file://{folder}", stretch=20_000).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-4, atol=1e-4) for k in want)


def test_conditions_choose_what_is_read(spark, folder):
    d = read_sound(spark, f"file://{folder}", measure="loudness", window=100, hop=10, stretch=400)
    a = f"file://{folder}/a.f32"
    whole = sorted((r.path, r.frame) for r in d.collect())
    for cond in ("frame > 7 AND frame <= 40", "frame = 3", "t >= 0.5 AND t < 0.7", f"path = '{a}' AND frame < 5", f"path IN ('{a}', 'x') AND t = {9 * 10 / 22050!r}", "frame > 5 AND frame < 5", "frame IS NULL", "size(measured) = 1 AND frame >= 2990"):
        got = sorted((r.path, r.frame) for r in d.where(cond).collect())
        checked = spark.createDataFrame([(*x, x[1] * 10 / 22050, [0.0]) for x in whole], "path string, frame long, t double, measured array<double>")
        assert got == sorted((r.path, r.frame) for r in checked.where(cond).collect()), cond
    assert "frame" in d.where("frame > 7")._jdf.queryExecution().executedPlan().toString()


def test_a_large_file_is_many_tasks(spark, tmp_path):
    path = tmp_path / "long.f32"
    with open(path, "wb") as f:
        f.truncate(3_000_000_000)
        f.seek(4 * 8192 * 80_000)
        f.write(np.ones(8192, "<f4").tobytes())
    d = read_sound(spark, f"file://{path}", measure="loudness", window=8192, hop=8192)
    assert d.rdd.getNumPartitions() == -(-91_552 // (64_000_000 // (4 * 8192)))
    near = d.where("frame BETWEEN 79999 AND 80001")
    assert near.rdd.getNumPartitions() == 1
    assert [r.measured[0] for r in near.orderBy("frame").collect()] == [0.0, 1.0, 0.0]


def test_written_sound_and_odd_options(spark, tmp_path):
    rows = [("k", 2, [3.0, None]), ("k", 1, [1.0, 2.0]), ("j", 1, None), (None, 1, [1.0]), ("j", 2, [])]
    d = spark.createDataFrame(rows, "k string, n int, x array<float>").repartition(3)
    path = f"file://{tmp_path}/made"
    assert sorted((r.path.rsplit("/", 1)[1], r.samples) for r in write_sound(d, "k", ["n"], "x", path).collect()) == [("j.f32", 0), ("k.f32", 3)]
    got = read_sound(spark, path, measure="loudness", window=1, hop=1).where(F.col("path").endswith("k.f32")).orderBy("frame").collect()
    assert [r.measured[0] for r in got] == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        SoundReader({"path": path, "measure": "smell"})
    with pytest.raises(FileNotFoundError):
        SoundReader({"path": f"file://{tmp_path}/nowhere"}).partitions()
