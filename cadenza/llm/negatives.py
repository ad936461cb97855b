"""Hard negatives for anchor vectors, found through the means and deviations of vector segments.

Within a segment of L components two vectors' product is L (mean mean' + c), |c| <= deviation deviation': the segments'
sums bound a score from either side. Bounds of few long segments come first; pairs that could still lie in a window of
scores are bounded by shorter segments, and only what is left is scored in full.

A task holds a block of rows and reads the anchors, some hundreds at a time, from a table in the shared folder, so neither
is broadcast and memory doesn't grow with them. A block gives out the best few rows of each window, and Spark takes the best
of all blocks. Windows are narrowed beforehand by the same scan over a sample of rows: what the sample holds already is a
bound for the whole, whatever the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.llm.common import Scratch, written

#: Segments a vector is cut into, level by level.
SEGMENTS = (4, 16)
#: Rows and bytes of a block, rows and anchors of its parts, rows of the sample and its tasks.
BLOCK_ROWS, BLOCK_BYTES, PART_ROWS, ANCHORS, SAMPLE, SAMPLE_TASKS = 65_536, 32_000_000, 8192, 256, 8192, 16
#: Pairs that are gathered at once; a share of pairs from which the whole product is cheaper than the pairs'.
AT_ONCE, DENSE = 100_000, 0.1
#: Scaled components beyond this can't be scored in a long.
LARGEST = 1 << 26
STORED = "vec_id long, label int, v binary, means binary, deviations binary"
FOUND = "anchor_id long, nth int, vec_id long, score long"
STORED_NAMES = ["vec_id", "label", "v", "means", "deviations"]
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def summaries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's mean and deviation, of all levels one after another, times the root of the segment's length."""
    means, deviations = [], []
    for s in SEGMENTS:
        parts = v.reshape(len(v), s, -1)
        root = parts.shape[2] ** 0.5
        means.append(parts.mean(2) * root)
        deviations.append(parts.std(2) * root)
    return np.concatenate(means, 1), np.concatenate(deviations, 1)


def stored(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, floor(scale * x) of the components (as 32-bit integers, with zeros up to a common length), summaries."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-max(longest, 1) // SEGMENTS[-1]) * SEGMENTS[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, label = batch.column("embedding"), batch.column("label")
            ids = batch.column("vec_id")
            n = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(n)), n)
            with np.errstate(invalid="ignore", over="ignore"):
                flat = np.floor(scale * flat)
                wrong = ~(np.abs(flat) <= LARGEST)  # null and NaN too
            fit = np.bincount(row, wrong, len(n)) == 0 if len(row) else np.ones(len(n), bool)
            for c in (lists, label, ids):
                fit &= ~c.is_null().to_numpy(zero_copy_only=False)
            v = np.zeros((len(n), width))
            v[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.where(wrong, 0, flat)
            v, take = v[fit], pa.array(np.flatnonzero(fit))
            if len(v):
                packed = lambda a, kind: pa.array([r.tobytes() for r in a.astype(kind)], pa.binary())
                means, deviations = summaries(v)
                yield pa.RecordBatch.from_arrays([ids.take(take), label.take(take), packed(v, "<i4"), packed(means, "<f8"), packed(deviations, "<f8")], STORED_NAMES)

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding").mapInArrow(run, STORED)


class Block:
    """Vectors with their summaries, by levels."""

    def __init__(self, table: pa.Table):
        whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(table.num_rows, -1)
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.v = whole("v", "<i4")
        cuts = np.cumsum(SEGMENTS)[:-1]
        self.levels = list(zip(np.split(whole("means", "<f8"), cuts, 1), np.split(whole("deviations", "<f8"), cuts, 1)))
        self.largest = int(np.abs(self.v).max(initial=0))

    def part(self, a: int, b: int) -> Block:
        part = object.__new__(Block)
        part.ids, part.labels, part.v, part.largest = self.ids[a:b], self.labels[a:b], self.v[a:b], self.largest
        part.levels = [(m[a:b], d[a:b]) for m, d in self.levels]
        return part


def products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of x with the rows j of y: one product of the whole where most pairs are asked for."""
    if len(i) > DENSE * len(x) * len(y):
        return (x @ y.T)[i, j]
    return np.concatenate([np.einsum("ij,ij->i", x[i[a : a + AT_ONCE]], y[j[a : a + AT_ONCE]]) for a in range(0, len(i), AT_ONCE)] or [np.zeros(0, x.dtype)])


def within(anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of an anchor and another row, of one label or of two, whose score is from low to high: both numbers, score."""
    i, j = np.nonzero(((anchors.labels[:, None] == rows.labels[None, :]) == same) & (anchors.ids[:, None] != rows.ids[None, :]) & (low <= high)[:, None])
    for (m, d), (own_m, own_d) in zip(rows.levels, anchors.levels):
        middle, reach = products(own_m, m, i, j), products(own_d, d, i, j)
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-3  # for what rounding may do to either
        may = (middle + reach >= low[i]) & (middle - reach <= high[i])
        i, j = i[may], j[may]
    exact = np.float64 if anchors.largest * rows.largest * rows.v.shape[1] < 1 << 53 else np.int64
    score = products(anchors.v.astype(exact), rows.v.astype(exact), i, j).astype(np.int64)
    held = (score >= low[i]) & (score <= high[i])
    return i[held], j[held], score[held]


def best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the first `most` of their anchor: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, i))
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < most]


def scan(rows: DataFrame, anchors: DataFrame, same: bool, most: int) -> DataFrame:
    """anchor_id, nth, vec_id, score: the best `most` rows of each block of rows in each anchor's windows.

    anchors is a written table: STORED with low and high, arrays of the windows' ends.
    """
    path = anchors.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(table)
            for some in _read(path):
                at, low, high = Block(some), *(_windows(some.column(c), fill) for c, fill in (("low", HIGHEST), ("high", LOWEST)))
                kept: list[np.ndarray] = []
                for a in range(0, len(block.ids), PART_ROWS):
                    part = block.part(a, a + PART_ROWS)
                    i, j, score = within(at, part, low.min(1), high.max(1), same)
                    for nth in range(low.shape[1]):
                        own = np.flatnonzero((score >= low[i, nth]) & (score <= high[i, nth]))
                        own = own[best(i[own], part.ids[j[own]], score[own], most)]
                        kept.append(np.stack([i[own], np.full(len(own), nth), part.ids[j[own]], score[own]]))
                i, nth, ids, score = np.concatenate(kept, 1)
                top = best(i * low.shape[1] + nth, ids, score, most)
                if len(top):
                    yield pa.RecordBatch.from_arrays([pa.array(at.ids[i[top]]), pa.array(nth[top].astype(np.int32)), pa.array(ids[top]), pa.array(score[top])], ["anchor_id", "nth", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _read(paths: list[str]) -> Iterator[pa.Table]:
    """The anchors, ANCHORS at most at once."""
    for path in paths:
        store, name = fs.FileSystem.from_uri(path)
        for batch in ds.dataset(name, filesystem=store, format="parquet").to_batches(batch_size=ANCHORS, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield pa.Table.from_batches([batch])


def _windows(lists: pa.ChunkedArray, fill: int) -> np.ndarray:
    lists = lists.to_pylist()
    out = np.full((len(lists), max(1, *map(len, lists))), fill, np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def first(found: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each anchor's windows, with their rank from 1."""
    w = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def narrowed(rows: DataFrame, anchors: DataFrame, same: bool, most: int, scratch: Scratch) -> DataFrame:
    """anchors, each window from the score that its `most`-th best row among `rows` has, where it has as many."""
    w = first(scan(rows, anchors, same, most), most).where(F.col("rank") == most)
    w = w.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("nth", "score"))).alias("least"))
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("least", i), x)))
    out = anchors.join(w, F.col("vec_id") == F.col("anchor_id"), "left").withColumn("low", raised)
    return scratch.written(out.select(*anchors.columns), "anchors")


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding (further columns are left out). A score is the inner product of floor(scale * x) of the
    components. Of each row for which `anchor`, a condition on vec_id, holds, the first `positives` other rows of its label
    and, for each of them, the first `negatives` rows of other labels whose score is from low to high per cent of the
    positive's, by descending score and ascending vec_id.

    Rows with a null vec_id, label or vector or a null or non-finite component take no part, nor do those with a component
    beyond LARGEST when scaled. A shorter vector counts as filled up with zeros. Rows that repeat a vec_id are rows by
    themselves but for anchors: there the least by label and stored bytes counts, and a row of the anchor's own vec_id is never its
    positive or negative. Without rows there is no result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    try:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Dealt by vec_id before anything is computed, so that a table of one file is the work of many tasks.
        kept = scratch.written(stored(vectors.repartition(tasks, "vec_id"), scale), "vectors")
        n = kept.count()
        sample = scratch.written(kept.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, SAMPLE / max(1, n)))), "sample").repartition(SAMPLE_TASKS, "vec_id")
        own = kept.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "means", "deviations")).alias("a")).select("vec_id", "a.*")
        bounds = lambda x: F.array(F.lit(x).cast("long"))
        own = scratch.written(own.withColumn("low", bounds(LOWEST)).withColumn("high", bounds(HIGHEST)), "anchors")
        found = first(scan(kept, narrowed(sample, own, True, positives, scratch), True, positives), positives)
        found = scratch.written(found.select("anchor_id", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        exact = F.col("positive_score").cast("decimal(20,0)")
        ends = F.struct("nth", F.ceil(exact * low / 100).cast("long").alias("low"), F.floor(exact * high / 100).cast("long").alias("high"))
        ends = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(ends)).alias("ends"))
        windows = own.drop("low", "high").join(ends, F.col("vec_id") == F.col("anchor_id"))
        windows = scratch.written(windows.select(*own.drop("low", "high").columns, F.col("ends.low").alias("low"), F.col("ends.high").alias("high")), "anchors")
        out = first(scan(kept, narrowed(sample, windows, False, negatives, scratch), False, negatives), negatives)
        out = out.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(found, ["anchor_id", "nth"])
        return written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    finally:
        scratch.remove()


#: Every anchor against every row, by integer products.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""
