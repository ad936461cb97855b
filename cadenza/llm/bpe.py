"""BPE encoding by backtracking over longest matches, and decoding through an offset table.

encode: an Aho-Corasick automaton of all tokens gives the longest token at every position of a pre-token. A token is
taken if it is compatible with the one before it, that is if merging the two one by one would leave them as they are;
else a shorter prefix is tried, and where none is left the token before is taken back. Positions that turned out dead
are marked, so every position is entered once: the result is the exact merge result in time linear in the length.
decode: one run of all tokens' bytes with the offset of each, read with one gather.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.common import corpus
from cadenza.llm.tokens import byte_chars, chunk_tokenizer, encoded

#: Pairs whose compatibility is kept in the table.
PAIRS = 1_000_000


class Vocabulary:
    """The bytes of each id, the two tokens that each was merged from, and the automaton of longest matches."""

    def __init__(self, tokenizer):
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        tokens = tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.bytes[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        special = set(tokenizer.get_added_tokens_decoder())
        self.id_of = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        self.split = [(i, i) for i in range(len(self.bytes))]
        self.merged: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self.longest_prefix(b) for b in self.bytes]
        # A token's two parts: those that the tokens merged before it leave of its bytes. Ids ascend with merge order.
        for i in sorted(self.id_of.values(), key=self.rank):
            if len(b := self.bytes[i]) > 1:
                left = next(a for k in range(1, len(b)) if (a := self.parts_at(b, k, i)))
                self.split[i], self.merged[left] = left, i
        self.table.clear()  # what held before all merges were known
        self.offsets = np.cumsum([0, *map(len, self.bytes)])
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)

    def rank(self, i: int) -> int:
        """Single bytes come before all merges, whatever their ids."""
        return i if len(self.bytes[i]) > 1 else -1

    def parts_at(self, b: bytes, k: int, i: int) -> tuple[int, int] | None:
        left, right = self.id_of.get(b[:k]), self.id_of.get(b[k:])
        if left is None or right is None or max(self.rank(left), self.rank(right)) >= self.rank(i):
            return None
        self.table.clear()
        return (left, right) if self.compatible(left, right) else None

    def longest_prefix(self, b: bytes) -> int:
        return next((self.id_of[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.id_of), -1)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a, b stay two tokens if their bytes are merged: no pair across the seam may be merged earlier than
        the merges that made the parts on either side of it."""
        known = self.table.get((a, b))
        if known is not None:
            return known
        left, right, limit, ok = a, b, len(self.bytes), True
        while True:
            made = self.merged.get((left, right))
            if made is not None and made < limit:
                ok = False
                break
            one_left, one_right = self.split[left][1] == left, self.split[right][0] == right
            if one_left and one_right:
                break
            if one_right or not one_left and left > right:  # undo the later merge of the two
                limit, left = left, self.split[left][1]
            else:
                limit, right = right + 1, self.split[right][0]
        if len(self.table) < PAIRS:
            self.table[a, b] = ok
        return ok

    def encode(self, word: bytes) -> list[int]:
        known = self.id_of.get(word)
        if known is not None and len(word) == 1:
            return [known]
        longest, size, shorter, table = [-1] * len(word), self.bytes, self.shorter, self.table
        for end, i in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - len(size[i])] = i  # matches come in order of their ends
        out, pos, dead, nxt = [], 0, set(), longest[0]
        while pos < len(word):
            last, token = out[-1] if out else -1, nxt
            while token >= 0:
                end = pos + len(size[token])
                if end not in dead:
                    ok = last < 0 or table.get((last, token))
                    if ok or ok is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                nxt = longest[pos] if pos < len(word) else -1
            else:
                dead.add(pos)
                nxt = out.pop()
                pos -= len(size[nxt])
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        n = self.offsets[ids + 1] - self.offsets[ids]
        at = np.repeat(self.offsets[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.pool[at]


class Backtracking:
    """The ids of one pre-token by this module's encoder."""

    def __init__(self, tokenizer):
        self.vocabulary = Vocabulary(tokenizer)

    def __call__(self, word: str) -> bytes:
        return array("I", self.vocabulary.encode(word.encode())).tobytes()


def decode(path: str, ids) -> str:
    """The text of any ids, invalid UTF-8 replaced."""
    vocabulary = chunk_tokenizer(path, Backtracking).encode_word.vocabulary
    return vocabulary.decode(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (the text decoded from them) per document.

    A null text counts as empty and has no ids; repeated rows give repeated rows; columns of docs other than doc_id and
    text are left out. Rows are independent: there is no shuffle, and memory is bounded by a batch and the kept chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, text, at, to in _round_trips(batches, path):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array([ids[4 * a : 4 * b] for a, b in zip(at, at[1:])], pa.binary()),
                 pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(to, to[1:])], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"])

    return corpus(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """As round_trip, with sha256 of the ids and of the decoded text in place of both, so that no text is sent back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, text, at, to in _round_trips(batches, path):
            sha = lambda raw, cuts, width: pa.array([hashlib.sha256(raw[width * a : width * b]).hexdigest() for a, b in zip(cuts, cuts[1:])])
            valid = pa.array([hashlib.sha256(bytes(text[a:b]).decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(to, to[1:])])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), sha(ids, at, 4), valid],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return corpus(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _round_trips(batches, path):
    """Parts of the batches with their ids and decoded bytes, and where each document begins in either."""
    for part, ids, at in encoded(batches, path, Backtracking):
        vocabulary = chunk_tokenizer(path, Backtracking).encode_word.vocabulary
        ends = np.concatenate([[0], np.cumsum(vocabulary.offsets[ids.astype(np.int64) + 1] - vocabulary.offsets[ids])])
        text = vocabulary.decode(ids.astype(np.int64)).tobytes()
        yield part, ids.tobytes(), text, at.tolist(), ends[at].tolist()
