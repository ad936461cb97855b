"""Token ids of whole texts, each distinct chunk of a batch encoded once.

A chunk is a stretch of text that the tokenizer's pre-tokenizer never joins with its neighbours, so the ids of a text are
those of its chunks in order. Texts are cut before spaces and before stops after a letter, and around line ends. Where
that isn't safe (two white-space characters in a row, the string of a special token) a text is cut by the pattern alone.
"""

from __future__ import annotations

import functools
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks kept per worker; longer ones than KEPT_CHARS are not kept.
KEPT, KEPT_CHARS = 500_000, 48
#: Bytes of text encoded at once.
AT_ONCE = 12_000_000
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ModelEncoder:
    """The ids of one pre-token by the tokenizers library's own model."""

    def __init__(self, tokenizer):
        self.model, self.chars = tokenizer.model, dict(enumerate(byte_chars()))

    def __call__(self, word: str) -> bytes:
        if not word.isascii() or not word.isprintable() or " " in word:
            word = word.encode().decode("latin-1").translate(self.chars)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()


class ChunkTokenizer:
    def __init__(self, path: str, encoder=ModelEncoder):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = "|".join(regex.escape(t["content"]) for t in spec["added_tokens"])
        self.byte_level = spec["pre_tokenizer"]["type"] == "ByteLevel"
        split = BYTE_LEVEL if self.byte_level else spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.encode_word = encoder(self.tokenizer)
        self.chunks: dict[str, bytes] = {}

    def encode_chunk(self, chunk: str) -> bytes:
        if not self.byte_level:
            chunk = chunk.lower() if chunk.isascii() else self.tokenizer.normalizer.normalize_str(chunk)
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha() and self.byte_level:
            return self.encode_word(chunk)
        words = self.pattern.findall(chunk)
        return self.encode_word(words[0]) if len(words) == 1 else b"".join(map(self.encode_word, words))

    def whole(self, text: str) -> bytes:
        """A text of any kind; the strings of special tokens become their ids."""
        out, at = [], 0
        for m in regex.finditer(self.specials, text) if self.specials else ():
            out += [self.encode_chunk(text[at : m.start()]), np.array([self.tokenizer.token_to_id(m[0])], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_chunk(text[at:])])

    def lookup(self, chunks: list[str]) -> list[bytes]:
        if len(self.chunks) > KEPT:
            self.chunks.clear()
        kept = self.chunks
        out = list(map(kept.get, chunks))
        for i, ids in enumerate(out):
            if ids is None:
                c = chunks[i]
                out[i] = ids = self.encode_chunk(c)
                if len(c) <= KEPT_CHARS:
                    kept[c] = ids
        return out

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts with a NUL at every safe cut, and which texts have to be encoded whole (they come out empty)."""
        odd = pc.match_substring(texts, "\0")
        if self.byte_level:
            odd = pc.or_(odd, pc.match_substring_regex(texts, SPACE + SPACE))
        if self.specials:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.specials))
        out = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        out = pc.replace_substring_regex(out, r"(\pL)([.,])", "\\1\0\\2")
        out = pc.replace_substring(out, " ", "\0 " if self.byte_level else "\0")
        return pc.replace_substring(out, "\n", "\0\n\0" if self.byte_level else "\0"), odd.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's ids begin (and the last one's end)."""
        texts = texts.cast(pa.large_string())
        plain, odd = self.cut(texts)
        parts = pc.split_pattern(plain, "\0")
        at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        codes, ids = coded.indices.to_numpy().astype(np.int64), self.lookup(coded.dictionary.to_pylist())
        if odd.any():
            where = np.flatnonzero(odd)
            codes[at[where]] = len(ids) + np.arange(len(where))
            ids += [self.whole(t) for t in texts.take(pa.array(where)).to_pylist()]
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
        n = lens[codes]
        ends = np.cumsum(n)
        where = np.repeat(starts[codes] - (ends - n), n)
        where += np.arange(len(where))
        return pool[where], np.concatenate([[0], ends])[at]


@functools.lru_cache(maxsize=4)
def chunk_tokenizer(path: str, encoder=ModelEncoder) -> ChunkTokenizer:
    return ChunkTokenizer(path, encoder)


def encoded(batches: Iterator[pa.RecordBatch], path: str, encoder=ModelEncoder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of their column `text`, at most about AT_ONCE bytes at once."""
    tokenizer = chunk_tokenizer(path, encoder)
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(size // AT_ONCE)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, *tokenizer.encode(part.column("text"))
