"""Byte-level BPE by ranks: a segment tree over a pre-token's bytes holds the leftmost least rank of its live pairs.

A live token starts at each live position; its entry in the tree is the rank of the pair it makes with the next live one.
The root says which pair is merged next. A merge changes three entries (the merged token's, its right part's, which dies, and
that of the live neighbour on its left), each a walk from a leaf to the root: a pre-token of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cadenza.llm.common import corpus
from cadenza.llm.tokens import AT_ONCE, ChunkTokenizer

#: An entry without a pair.
NONE = 1 << 62


class SegmentTree:
    """The ids of one pre-token by a dictionary of ranks; a rank is its token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=0)

    def __call__(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.ranks.get(raw)
        return array("I", self.merge(raw) if whole is None else [whole]).tobytes()

    def merge(self, raw: bytes) -> list[int]:
        n = len(raw)
        if n < 2:
            return [self.ranks[raw]] if n else []
        ranks, longest = self.ranks, self.longest
        bits = n.bit_length()
        size, place = 1 << (n - 1).bit_length(), (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is a pair's rank with its position below it, so the least entry is the leftmost of the least rank.
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << bits | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, entry: int) -> None:
            k = size + i
            tree[k] = entry
            while k > 1:
                other = tree[k ^ 1]
                if other < entry:
                    entry = other
                k >>= 1
                if tree[k] == entry:
                    return
                tree[k] = entry

        def pair(i: int) -> int:
            """The entry of the token at i with the next live one."""
            middle = after[i]
            if middle >= n or (end := after[middle]) - i > longest:
                return NONE
            rank = ranks.get(raw[i:end])
            return NONE if rank is None else rank << bits | i

        while (least := tree[1]) != NONE:
            i = least & place
            dead = after[i]
            after[i] = end = after[dead]
            if end < n:
                before[end] = i
            put(dead, NONE)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : after[i]]])
            i = after[i]
        return out


class RankTokenizer(ChunkTokenizer):
    """Whole texts by a file of ranks and a pattern; there are no special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f.read().splitlines()))}
        self.specials, self.byte_level, self.chunks = "", True, {}
        self.pattern, self.encode_word = regex.compile(pattern), SegmentTree(ranks)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes, self.decimals = Pool(tokens), Pool([b"%d " % i for i in range(len(tokens))])


class Pool:
    """Strings by number, all in one run of bytes with the offset of each."""

    def __init__(self, strings: list[bytes]):
        self.offsets, self.run = np.cumsum([0, *map(len, strings)]), np.frombuffer(b"".join(strings), np.uint8)

    def take(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of ids one after another, and where those of each slice begin."""
        n = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.offsets[ids] - ends[:-1], n)
        where += np.arange(len(where))
        return self.run[where].tobytes(), ends[cuts].tolist()


@functools.lru_cache(maxsize=4)
def rank_tokenizer(path: str, pattern: str) -> RankTokenizer:
    return RankTokenizer(path, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str):
    """Parts of the batches, about AT_ONCE bytes of text each, with the tokenizer, the ids and where each document begins."""
    tokenizer = rank_tokenizer(path, pattern)
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(size // AT_ONCE)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                ids, at = tokenizer.encode(part.column("text"))
                yield part, tokenizer, ids.astype(np.int64), at


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) per document, by the ranks at `path`, each match of `pattern` by itself.

    A null text counts as empty and has no ids; repeated rows give repeated rows; other columns of docs are left out. Rows are
    independent: there is no shuffle, and memory is bounded by a batch, its longest text and the kept chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids, at in _encoded(batches, path, pattern):
            values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "ids"])

    return corpus(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of each row of ids; null ids give no bytes. Single tokens needn't be whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = rank_tokenizer(path, pattern)
        for batch in batches:
            lists = pc.coalesce(batch.column("ids"), pa.scalar([], batch.schema.field("ids").type))
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            raw, ends = tokenizer.bytes.take(lists.flatten().to_numpy().astype(np.int64), cuts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the decimal ids joined by a space and of the bytes decoded from them, rows as encode's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokenizer, ids, at in _encoded(batches, path, pattern):
            (said, to), (raw, ends) = tokenizer.decimals.take(ids, at), tokenizer.bytes.take(ids, at)
            sha = lambda x, cuts, less: pa.array([hashlib.sha256(x[a : max(a, b - less)]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), sha(said, to, 1), sha(raw, ends, 0)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return corpus(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
