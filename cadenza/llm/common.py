"""What the operators of this folder share: the shared scratch folder, the columns of a corpus, runs of equal keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_local: dict[str, str] = {}

#: Rows up to which a table may be sent to every executor.
BROADCAST_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only for a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: this cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of tables within the shared one, which are removed together when what they led to has been written."""

    def __init__(self, spark: SparkSession, name: str):
        self.path, self.n = scratch_path(spark, name), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text (null: empty), with further columns; whatever else docs has is left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def join_small(df: DataFrame, small: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Left join by null-safe keys with a table of one row per key. It is broadcast only after its rows were counted;
    a larger one is repeated over `salts`, so that a hot key spreads over as many tasks."""
    small = written(small, "small")
    b = small.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    if small.count() <= BROADCAST_ROWS:
        out = df.join(F.broadcast(b), same, "left")
    else:
        df = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        b = b.withColumn("_b_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = df.join(b, [*same, F.col("_salt") == F.col("_b_salt")], "left").drop("_salt", "_b_salt")
    return out.drop(*[f"_b_{k}" for k in keys])


def join_counted(df: DataFrame, counted: DataFrame, key: str, size: str = "size", share: int = 1000) -> DataFrame:
    """Inner join of df, a written table, with one row per key; `size` says how many rows of df have the key. Keys of more
    than 1 / share of df's rows, of which there are fewer than `share`, are broadcast, so that their rows stay where they
    are; the others are joined by a shuffle in which no key is hot."""
    hot = F.col(size) > max(1, df.count() // share)
    large = F.broadcast(counted.where(hot))
    rest = df.join(F.broadcast(large.select(key)), key, "left_anti")
    return df.join(large, key).unionByName(rest.join(counted.where(~hot), key))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 4_000_000, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `size` bytes of a column and `rows` rows at most; a longer value is a part by itself."""
    for batch in batches:
        weight = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)) + size / rows)
        cuts = [0, *(np.flatnonzero(np.diff(weight // size)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def range_cells(df: DataFrame, column: str, rows: int, most: int = 65_536) -> tuple[Column, int]:
    """An expression that numbers ranges of an integer column from 0 in ascending order, about `rows` rows in each,
    and how many there are. Only quantiles reach the driver, `most` at most."""
    n, lo = df.agg(F.count(column), F.min(column)).first()
    cells = int(max(1, min(most, n // rows)))
    if cells < 2:
        return F.lit(0), 1
    at = [i / cells for i in range(1, cells)]
    cuts = sorted(set(df.agg(F.percentile_approx(column, at, max(10_000, 20 * cells))).first()[0]) - {lo})
    if not cuts:
        return F.lit(0), 1
    step = max(1, round(len(cuts) ** 0.5))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    array = lambda xs: F.expr("array(" + ",".join(f"{x}L" for x in xs) + ")")
    x = F.col(column)
    coarse = F.size(F.filter(array([f[0] for f in fine]), lambda c: c <= x))
    rest = F.size(F.filter(F.get(F.array(*[array(f) for f in fine]), coarse - 1), lambda c: c <= x))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + rest).cast("int"), len(cuts) + 1


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal few rows that each stand for much work over as many tasks as a shuffle has; Spark doesn't merge these."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by key, regrouped so that no key is cut: tables with the bounds of their runs of equal keys."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if last == 0 and (not kept or kept[-1].column(key)[-1].as_py() == k[0]):
            kept.append(batch)
            continue
        whole = pa.Table.from_batches([*kept, batch.slice(0, last)])
        kept = [batch.slice(last)]
        if whole.num_rows:
            yield whole, bounds(whole.column(key).to_numpy())
    if kept:
        whole = pa.Table.from_batches(kept)
        yield whole, bounds(whole.column(key).to_numpy())


def bounds(k: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
