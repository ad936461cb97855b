"""Files of 32-bit little-endian samples of one channel as a Spark source, read by ranges.

    read_sound(spark, "s3://bucket/folder", measure="semitones")

A row is a window of a file: path, frame (its number), t (its beginning in seconds), measured (what `measure` makes of its
samples). Windows begin `hop` samples apart. A file of any length is cut into stretches of whole hops, each an input
partition that reads its own bytes and, beyond its end, what its last windows reach into; a stretch is measured a few
hundred windows at a time. Conditions on path and frame are answered while stretches are planned, those on t narrow them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cadenza.functions.audio import HOP, RATE, WINDOW, loudness, semitones

MEASURES = {"semitones": semitones, "loudness": loudness}
#: Bytes of a stretch, and windows measured at once.
STRETCH, AT_ONCE = 64_000_000, 256


def read_sound(spark: SparkSession, path: str, **options) -> DataFrame:
    """Windows of the files of path, with the options of Sound. It lets the session push filters to Python sources."""
    spark.dataSource.register(Sound)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sound").options(**options).load(path)


@dataclass
class Stretch(InputPartition):
    path: str
    first: int
    last: int


class Sound(DataSource):
    """Options: path (a file or a folder), measure, window, hop (in samples), rate (samples a second), stretch (bytes),
    suffix (of the files in a folder)."""

    @classmethod
    def name(cls) -> str:
        return "sound"

    def schema(self) -> str:
        return "path string, frame long, t double, measured array<float>"

    def reader(self, schema) -> DataSourceReader:
        return SoundReader(self.options)


class SoundReader(DataSourceReader):
    def __init__(self, options):
        number = lambda name, default: type(default)(options.get(name, default))
        self.root, self.suffix = options["path"], options.get("suffix", ".f32")
        self.window, self.hop, self.rate = number("window", WINDOW), number("hop", HOP), number("rate", float(RATE))
        self.measure = options.get("measure", "semitones")
        if self.measure not in MEASURES:
            raise ValueError(f"measure is one of {sorted(MEASURES)}")
        if self.window < 1 or self.hop < 1:
            raise ValueError("window and hop are at least 1")
        self.frames = max(1, number("stretch", STRETCH) // (4 * self.hop))
        self.paths: set[str] | None = None
        self.low, self.high = 0, math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "path" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
            elif column in ("frame", "t") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None and math.isfinite(f.value):
                # a time may lie on either side of a frame's by rounding: one frame more each way, and Spark looks again
                at, slack = (f.value, 0) if column == "frame" else (f.value * self.rate / self.hop, 1)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, math.floor(at) - slack if slack else at + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, math.ceil(at) + 1 + slack if slack else at + 1 - isinstance(f, LessThan))
                if slack:
                    yield f
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        """The files with their sizes; a path names its file again as it was given."""
        store, root = fs.FileSystem.from_uri(self.root)
        one = store.get_file_info(root)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [one] if one.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(self.suffix)]
        given = self.root.rstrip("/")
        return sorted((given + i.path.removeprefix(root.rstrip("/")), i.size) for i in found)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in self.files():
            if self.paths is None or path in self.paths:
                n = max(0, 1 + (size // 4 - self.window) // self.hop)
                low, high = max(0, self.low), min(n, self.high)
                out += [Stretch(path, a, min(a + self.frames, high)) for a in range(low, high, self.frames)]
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        store, name = fs.FileSystem.from_uri(partition.path)
        measure = MEASURES[self.measure](self.window, self.rate)
        with store.open_input_file(name) as f:
            for a in range(partition.first, partition.last, AT_ONCE):
                at = np.arange(a, min(a + AT_ONCE, partition.last))
                raw = f.read_at(4 * ((len(at) - 1) * self.hop + self.window), 4 * a * self.hop)
                x = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, "<f4"), self.window)[:: self.hop]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * len(at), pa.string()), pa.array(at), pa.array(at * self.hop / self.rate), pa.array(list(measure(x)), pa.list_(pa.float32()))],
                    ["path", "frame", "t", "measured"])


def write_sound(df: DataFrame, key: str, order: list[str], samples: str, path: str) -> DataFrame:
    """path and samples of a file for each key, in a folder: the arrays of its rows one after another, in order; null
    arrays and null samples are left out. Rows stream to their file, so a key may be longer than memory. A file gets its
    name when it is whole: a task that runs again writes it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        now, out, n = None, None, 0

        def closed() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                store.move(f"{root}/{now}.part-{mine}", f"{root}/{now}.f32")
                yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{now}.f32"]), pa.array([n], pa.int64())], ["path", "samples"])

        import uuid

        mine = uuid.uuid4().hex[:12]
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != now:
                    yield from closed()
                    now, n = k, 0
                    out = store.open_output_stream(f"{root}/{k}.part-{mine}")
                if x.is_valid:
                    own = x.values.drop_null().to_numpy().astype("<f4")
                    out.write(own.tobytes())
                    n += len(own)
        yield from closed()

    d = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return d.select(F.col(key).cast("string").alias("key"), samples).mapInArrow(run, "path string, samples long")
