"""Documents packed into sequences of a fixed number of tokens: dominance reduction, then best fit.

The instance is the histogram of piece lengths, at most `capacity` numbers however large the corpus. Sets that provably
dominate every other way to use a piece are fixed first (after Martello and Toth): the largest piece j with one piece k
dominates if no set of other pieces that fits beside j is larger than k, which holds whenever k fills the sequence; j
alone dominates if nothing fits beside it. Fixing them shrinks the instance without losing an optimal packing, and may
let further sets dominate, so this is repeated. What remains is packed best-fit in descending order, many equal
sequences at a time. Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.llm.common import corpus, written
from cadenza.llm.tokens import encoded

Pattern = tuple[tuple[int, int], ...]  # (length, copies) from offset 0 on


def reachable(count: dict[int, int], capacity: int) -> int:
    """Bit s is set if some pieces have the sum s."""
    sums, mask = 1, (1 << capacity + 1) - 1
    for n, c in count.items():
        c, step = min(c, capacity // n), 1
        while c > 0:
            step = min(step, c)
            sums |= sums << n * step & mask
            c -= step
            step *= 2
    return sums


def reduce(count: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets and take them out of count."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(pattern: Pattern, times: int) -> None:
        fixed.append((pattern, times))
        for n, copies in pattern:
            count[n] -= times * copies
            if not count[n]:
                del count[n]

    again = True
    while again and count:
        again = False
        sums = reachable(count, capacity)  # a superset of what is left as pieces go
        for j in sorted(count, reverse=True):
            while count.get(j):
                rest = capacity - j
                largest = max(0, (sums & (1 << rest + 1) - 1).bit_length() - 1)  # no set beside j is larger
                k = next((n for n in range(min(rest, largest), 0, -1) if n in count and (n != j or count[j] > 1)), 0)
                if k != largest and k:
                    break
                if not k:
                    if any(n <= rest for n in count if n != j) or j <= rest and count[j] > 1:
                        break
                    fix(((j, 1),), count[j])
                elif k == j:
                    fix(((j, 2),), count[j] // 2)
                else:
                    fix(((j, 1), (k, 1)), min(count[j], count[k]))
                again = True
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in descending order over groups of equal sequences."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    free = 0  # bit r: some sequence has room r

    def put(pattern: Pattern, room: int, times: int) -> None:
        nonlocal free
        open_.setdefault(room, []).append((pattern, times))
        free |= 1 << room

    for n in sorted(count, reverse=True):
        c = count[n]
        while c:
            above = free >> n
            if above:
                room = n + (above & -above).bit_length() - 1
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    free &= ~(1 << room)
            else:
                room, pattern, times = capacity, (), c
            most = room // n
            full = min(times, c // most)
            if full:
                put((*pattern, (n, most)), room - most * n, full)
            c -= full * most
            left = times - full
            if c and left:
                put((*pattern, (n, c)), room - c * n, 1)
                c, left = 0, left - 1
            if left and pattern:
                put(pattern, room, left)
    return [x for xs in open_.values() for x in xs]


def places(count: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of places: the rank-th piece of a length, from key = length << 40 | first rank on, goes into sequence
    `sequence` + its rank in the run, at `offset`. Their number depends on the lengths, not on the number of pieces."""
    count = dict(count)
    packed = reduce(count, capacity) + best_fit(count, capacity)
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in packed:
        offset = 0
        for n, copies in pattern:
            for _ in range(copies):
                out.append((n << 40 | used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + times
                offset += n
        sequence += times
    out.sort()
    key, seq, off = np.array(out or [(0, 0, 0)], np.int64).T
    return {"key": key, "sequence": seq, "offset": off}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) per piece; and _task, _nth: the piece is the _nth of its length
    in its task. Null texts are empty: the end id alone. Only documents longer than capacity are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for part, ids, at in encoded(batches, tokenizer):
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            n = np.diff(at)
            k = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            order = np.argsort(length, kind="stable")
            nth = np.empty(len(doc), np.int64)
            by = length[order]
            nth[order] = np.arange(len(doc)) - np.searchsorted(by, by) + seen[by]
            seen += np.bincount(length, minlength=capacity + 1)
            raw, a = ids.astype("<u4").tobytes(), ((at[:-1][doc] + start) * 4).tolist()
            own = [raw[x : x + 4 * m] for x, m in zip(a, length.tolist())]
            columns = {"doc_id": part.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()), "_task": pa.array(np.full(len(doc), task), pa.int32()), "_nth": nth}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(own, pa.binary())} if with_ids else {}))

    return corpus(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece of a document (and its ids).

    Sequences are numbered from 0 and filled from offset 0 without gaps. Repeated rows are packed each; an empty table
    gives no row; other columns are left out. Lengths are counted over all pieces; the driver sees the histogram only.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    by_task = cut.groupBy("_task", "length").agg(F.count("*").alias("n"))
    by_task = written(by_task, "lengths")
    count = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = spark.sparkContext.broadcast(places(count, capacity))
    before = by_task.select("_task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("_task")) - F.col("n")).alias("_before"))
    # by a shuffle of narrow rows: `before` has a row for each task and length, so it grows with the corpus
    ranked = cut.join(before.hint("merge"), ["_task", "length"]).withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_before", "_nth", "_task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = runs.value
        for b in batches:
            key = b.column("length").to_numpy() << 40 | b.column("_rank").to_numpy()
            i = np.searchsorted(at["key"], key, "right") - 1
            out = {c: b.column(c) for c in b.schema.names if c != "_rank"}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": at["sequence"][i] + key - at["key"][i], "offset": at["offset"][i]})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "_rank").mapInArrow(run, schema)
