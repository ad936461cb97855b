"""Token ids in directly addressable codes: any token of a file is read without decoding the ones before it.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, a bitmap that
says which ids go on, and a rank directory: how many bits are set before every 512th. The chunk of token i on the next
level stands at the rank of i, so reading a token takes one step a level.

File: the magic word, then little-endian 64-bit integers: number of documents, tokens and levels; doc_ids; the token at
which each document starts, and the number of tokens; and for each level its number of chunks, then its chunks, bitmap
and rank directory, each padded to 8 bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.llm.common import corpus, range_cells, scratch_path, spread, written
from cadenza.llm.tokens import encoded

MAGIC = b"DACIDS01"
BLOCK = 512
#: Stands for a null doc_id in a file.
NULL_ID = -(1 << 63)


def _padded(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def dump(doc_ids: np.ndarray, at: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of documents whose ids are ids[at[i] : at[i + 1]]."""
    levels, x = [], ids.astype(np.uint32)
    while True:
        more = x > 255
        bitmap = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)]).reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint64)
        levels += [np.array([len(x)], "<u8"), (x & 255).astype(np.uint8), bitmap, np.concatenate([[0], np.cumsum(ones)]).astype("<u8")]
        if not more.any():
            break
        x = x[more] >> 8
    head = np.array([len(doc_ids), len(ids), len(levels) // 4], "<u8")
    return MAGIC + b"".join(map(_padded, [head, doc_ids.astype("<i8"), at.astype("<u8"), *levels]))


class Codes:
    """A file's codes, by the bytes of the file."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.raw, self.to = raw, 8
        n, self.tokens, k = map(int, self._take("<u8", 3))
        self.doc_ids, self.at = self._take("<i8", n), self._take("<u8", n + 1).astype(np.int64)
        self.levels = []
        for _ in range(k):
            m = int(self._take("<u8", 1)[0])
            self.levels.append((self._take(np.uint8, m), self._take(np.uint8, -(-m // 8)), self._take("<u8", -(-m // BLOCK) + 1)))

    def _take(self, kind, n: int) -> np.ndarray:
        x = np.frombuffer(self.raw, kind, n, self.to)
        self.to += x.nbytes + -x.nbytes % 8
        return x

    def rank(self, level: int, i: int) -> int:
        """How many of the first i chunks go on to the next level."""
        _, bitmap, directory = self.levels[level]
        block, rest = divmod(i, BLOCK)
        own = bitmap[block * BLOCK // 8 : -(-i // 8)]
        ones = int(np.bitwise_count(own).sum()) if rest else 0
        if rest % 8:
            ones -= int(own[-1] >> (rest % 8)).bit_count()
        return int(directory[block]) + ones

    def token(self, i: int) -> int:
        out = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * k
            if not bitmap[i // 8] >> i % 8 & 1:
                return out
            i = self.rank(k, i)
        raise ValueError("a code goes on after the last level")

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Tokens a to b (without b)."""
        chunks, bitmap, _ = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        more = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        if more.any():
            r = self.rank(level, a)
            out[more] |= self.slice(r, r + int(more.sum()), level + 1) << 8
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int | None = None, rows: int = 2048, file_bytes: int = 32_000_000) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns one row per file: cell, part, path, n_docs,
    n_tokens. (cell, part) is the order of the files.

    Documents are dealt by ranges of doc_id, about `rows` in each, and sorted; a file is closed after file_bytes of
    text, so a range of many or long documents takes several. Null texts are empty (the end id alone); null ids come first
    and are read back as null; rows with one doc_id stay apart, next to each other. An attempt of a task writes under names of its own and only the files of the
    attempt that Spark took are listed. Columns other than doc_id and text are left out; an empty table has no file.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "dac")
    docs = corpus(docs)
    cell, _ = range_cells(docs, "doc_id", rows)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        kept, size, part, now = [], 0, 0, None

        def close():
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            ids, sizes = [], []
            for _, x, at in encoded([whole], tokenizer):
                ends, n = at[1:], len(at) - 1
                ids.append(x if end_id is None else np.insert(x, ends, end_id))
                sizes.append(np.diff(at) + (end_id is not None))
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            name = f"{now:06d}-{part:04d}-{uuid.uuid4().hex[:8]}.dac"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(dump(pc.fill_null(whole.column("doc_id"), NULL_ID).to_numpy(), at, np.concatenate(ids)))
            return pa.RecordBatch.from_pydict({"cell": pa.array([now], pa.int32()), "part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [whole.num_rows], "n_tokens": [int(at[-1])]})

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            a = 0
            while a < batch.num_rows:
                if kept and (cells[a] != now or size >= file_bytes):
                    yield close()
                    part = part + 1 if cells[a] == now else 0
                    kept, size = [], 0
                now = int(cells[a])
                done = int(sizes[a - 1]) if a else 0
                b = min(int(np.searchsorted(cells, now, "right")) if cells[-1] != now else batch.num_rows, int(np.searchsorted(sizes, done + file_bytes - size)) + 1)
                kept.append(batch.slice(a, b - a))
                size += int(sizes[b - 1]) - done
                a = b
        if kept:
            yield close()

    dealt = docs.withColumn("cell", cell).repartition("cell").sortWithinPartitions("cell", "doc_id", "text")
    return written(dealt.mapInArrow(save, "cell int, part int, path string, n_docs long, n_tokens long"), "dac-files")


def starts(files: DataFrame) -> DataFrame:
    """The number of tokens before each file: sums within 256 ranges, then over the ranges before."""
    files = files.withColumn("_block", F.expr("cell div 256"))
    blocks = files.groupBy("_block").agg(F.sum("n_tokens").alias("_n"))  # 256 of them at most
    before = blocks.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_before"))
    own = F.sum("n_tokens").over(W.partitionBy("_block").orderBy("cell", "part")) - F.col("n_tokens")
    return files.join(F.broadcast(before), "_block").withColumn("first", own + F.col("_before")).drop("_block", "_before")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit), from the files."""
    return _read(files, lambda raw: raw, "ids", "binary", pa.binary())


def read_digests(files: DataFrame) -> DataFrame:
    """As read, with the unsigned crc32 of the ids in their place."""
    return _read(files, zlib.crc32, "ids_crc32", "long", pa.int64())


def _read(files: DataFrame, of, name: str, sql_type: str, arrow_type: pa.DataType) -> DataFrame:
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                store, p = fs.FileSystem.from_uri(path)
                with store.open_input_file(p) as f:
                    codes = Codes(f.read())
                at = codes.at.tolist()
                raw = codes.slice(0, codes.tokens).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes.doc_ids, mask=codes.doc_ids == NULL_ID), pa.array(codes.at[:-1] + first), pa.array(np.diff(codes.at)), pa.array([of(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], arrow_type)],
                    ["doc_id", "start", "n_tokens", name])

    dealt = spread(starts(files).select("path", "first"), "path")
    return dealt.mapInArrow(load, f"doc_id long, start long, n_tokens long, {name} {sql_type}")
