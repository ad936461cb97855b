"""Pitch of short frames of sound, a batch of frames at a time; spectra of sound files by semitone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Loudness below which there is silence, range searched and given out in Hz, least clarity of the best and
# of a chosen peak, and its least share of the best.
SILENCE, SEARCHED, GIVEN, CLEAR, CHOSEN, SHARE = 0.008, (75.0, 800.0), (60.0, 900.0), 0.55, 0.5, 0.8


def pitch_of(x: np.ndarray, rate: float) -> float | None:
    """The frame's pitch as a MIDI number: first clear peak of the normalised square difference, refined by a parabola."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 4 or np.sqrt(np.mean(x * x)) < SILENCE:
        return None
    low, high = max(2, int(rate / SEARCHED[1])), min(n - 2, int(np.ceil(rate / SEARCHED[0])))
    if high <= low:
        return None
    spectrum = np.fft.rfft(x, 2 * n)
    shared = np.fft.irfft(spectrum * np.conj(spectrum))[: high + 2]
    squares = np.concatenate([[0.0], np.cumsum(x * x)])
    lag = np.arange(high + 2)
    power = squares[n - lag] + squares[n] - squares[lag]
    d = 2 * shared / np.maximum(power, 1e-12)
    best = d[low : high + 1].max()
    if best < CLEAR:
        return None
    peak = (d[low : high + 1] > max(SHARE * best, CHOSEN)) & (d[low : high + 1] >= d[low - 1 : high]) & (d[low : high + 1] > d[low + 1 : high + 2])
    if not peak.any():
        return None
    i = low + int(np.argmax(peak))
    a, b, c = d[i - 1], d[i], d[i + 1]
    bend = a - 2 * b + c
    f = rate / (i + (0.5 * (a - c) / bend if bend else 0.0))
    return float(69 + 12 * np.log2(f / 440)) if GIVEN[0] <= f <= GIVEN[1] else None


def pitch(frame: Column, rate: float) -> Column:
    """MIDI number of each frame (an array of samples), null for silence or noise."""

    @F.pandas_udf("double")
    def of(frames: pd.Series) -> pd.Series:
        return frames.map(lambda x: None if x is None else pitch_of(x, rate)).astype("float64")

    return of(frame)


# Samples a second, samples in a window and between windows, semitones, and the band of each as shares of
# its frequency.
RATE, WINDOW, HOP, SEMITONES, BAND = 22050, 8192, 1024, (30, 96), (0.971, 1.03)


def semitones(window: int, rate: float) -> Callable[[np.ndarray], np.ndarray]:
    """Of windows of samples, a row each, the strongest bin of each of SEMITONES; 0 where no bin is in its band."""
    hz = 440 * 2 ** ((np.arange(SEMITONES[0], SEMITONES[1] + 1) - 69) / 12)
    bins = np.searchsorted(np.fft.rfftfreq(window, 1 / rate), [hz * BAND[0], hz * BAND[1]]).T.tolist()
    shape = np.hanning(window).astype(np.float32)

    def energies(x: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(x * shape, axis=1)).astype(np.float32)
        return np.column_stack([power[:, u:v].max(1) if v > u else np.zeros(len(x), np.float32) for u, v in bins])

    return energies


def loudness(window: int, rate: float) -> Callable[[np.ndarray], np.ndarray]:
    """The root of the mean square of each window."""
    return lambda x: np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64) / window).astype(np.float32)[:, None]


def semitone_energies(files: DataFrame, rate: float = RATE) -> DataFrame:
    """path, frame, t and energy of every window of small files of samples, a file a row (path, content, as the binaryFile
    source reads them; files of any size: sources.sound). A file that is null or shorter than a window gives no row; samples
    beyond the last whole one are left out. Windows are transformed 256 at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        energies = semitones(WINDOW, rate)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                raw = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                x = np.frombuffer(raw, "<f4", raw.size // 4)
                n = max(0, 1 + (len(x) - WINDOW) // HOP)
                for first in range(0, n, 256):
                    at = np.arange(first, min(n, first + 256))
                    own = np.lib.stride_tricks.sliding_window_view(x[first * HOP : (at[-1] * HOP) + WINDOW], WINDOW)[::HOP]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(at), pa.string()), pa.array(at), pa.array(at * HOP / rate), pa.array(list(energies(own)), pa.list_(pa.float32()))], ["path", "frame", "t", "energy"])

    return files.select("path", "content").mapInArrow(run, "path string, frame long, t double, energy array<float>")


def pitch_classes(energy: Column) -> Column:
    """Of semitone energies the twelve classes (0 is C), the strongest first, each with its greatest energy; ties by class."""
    low = SEMITONES[0]
    own = lambda c: F.array_max(F.filter(energy, lambda e, i: F.pmod(i + low, F.lit(12)) == c))
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda c: F.struct((-own(c)).alias("e"), c.alias("class"))))
    return F.transform(ranked, lambda s: F.struct(s["class"].alias("class"), (-s["e"]).alias("energy")))
