"""Known words of texts with their readings: leftmost-longest matches against a dictionary of any size.

The dictionary is a table. Up to WORDS of it at a time travel to the executors, which build one automaton per process and run
through each text once, whatever the number of words; a larger dictionary is matched in several shares, each by a pass of
its own, and what the shares found is settled in one more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words that an executor holds at once; characters of texts whose matches a task holds at once (one text at least).
WORDS = 500_000
CHARACTERS = 200_000
SPANS = "array<struct<start:int,base:string,reading:string>>"
FOUND = "array<struct<start:int,rank:int,size:int,base:string,reading:string>>"
#: Where a word is one: anywhere, after a digit (spaces between don't matter), after a Han or Katakana character. At one
#: place the later kinds go first.
ANYWHERE, AFTER_WORD, AFTER_DIGIT = 0, 1, 2
KINDS = {"word": AFTER_WORD, "digit": AFTER_DIGIT}

_built: dict[str, Matcher] = {}


def is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "々〆ヶ" or c >= "\U00020000"


def is_word(c: str) -> bool:
    return is_han(c) or "゠" <= c <= "ヿ"


class Matcher:
    def __init__(self, entries: list[tuple[str, str, int]]):
        """entries: word, reading, kind; of a word's readings of one kind the first in order counts."""
        words: dict[str, dict[int, str]] = {}
        for word, reading, kind in sorted(entries):
            words.setdefault(word, {}).setdefault(kind, reading)
        self.words = list(words.items())
        self.automaton = ahocorasick.Automaton()
        for i, (word, _) in enumerate(self.words):
            self.automaton.add_word(word, i)
        if self.words:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int, str, str]]:
        """At every place the word that goes first there: (start, -kind, -length, base, reading), by start."""
        best: dict[int, tuple] = {}
        for end, i in self.automaton.iter(text) if self.words else ():
            word, kinds = self.words[i]
            start = end + 1 - len(word)
            if len(kinds) == 1 and ANYWHERE in kinds:
                kind = ANYWHERE
            else:
                at = start
                while at and text[at - 1] in " 　":
                    at -= 1
                before = text[at - 1] if at else ""
                kind = max((k for k in kinds if k == ANYWHERE or k == AFTER_DIGIT and before.isdecimal() or k == AFTER_WORD and before and is_word(before)), default=None)
            if kind is not None and (-kind, -len(word)) < best.get(start, (1,))[:2]:
                han = next((k for k, c in enumerate(word) if not is_han(c)), len(word))
                best[start] = (-kind, -len(word), word[:han] or word, kinds[kind])
        return [(start, *best[start]) for start in sorted(best)]


def settled(found: list[tuple]) -> list[tuple]:
    """From the left, what doesn't begin within a word taken before."""
    out, end = [], 0
    for start, _, size, base, reading in found:
        if start >= end:
            out.append((start, base, reading))
            end = start - size
    return out


def few(texts: pa.Array, most: int) -> Iterator[list[str | None]]:
    """The texts in order, a list of so many characters at a time, or of one text."""
    out, size = [], 0
    for t in (x.as_py() for x in texts):
        if out and size + len(t or "") > most:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t or "") + 1
    if out:
        yield out


def _matched(df: DataFrame, text: str, entries: list[tuple], name: str, whole: bool) -> DataFrame:
    shared, token = df.sparkSession.sparkContext.broadcast(entries), uuid.uuid4().hex
    fields = ["start", "base", "reading"] if whole else ["start", "rank", "size", "base", "reading"]
    kinds = {"base": pa.string(), "reading": pa.string()}

    @F.arrow_udf(SPANS if whole else FOUND)
    def match(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if token not in _built:
            _built.clear()
            _built[token] = Matcher(shared.value)
        matcher = _built[token]

        def spans(part: list[str | None]) -> pa.Array:
            rows = [None if t is None else matcher.found(t) for t in part]
            rows = [r if r is None or not whole else settled(r) for r in rows]
            flat = [x for r in rows for x in r or ()]
            columns = [pa.array([x[i] for x in flat], kinds.get(f, pa.int32())) for i, f in enumerate(fields)]
            offsets = np.concatenate([[0], np.cumsum([len(r or ()) for r in rows])])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields), mask=pa.array([r is None for r in rows], pa.bool_()))

        for batch in texts:  # what is found is Python's objects for a few texts only
            yield pa.concat_arrays([spans([]), *(spans(part) for part in few(batch, CHARACTERS))])

    return df.withColumn(name, match(F.col(text)))


def annotated(df: DataFrame, text: str, dictionary: DataFrame, name: str = "spans", words: int = WORDS) -> DataFrame:
    """df with an array of spans (start, from 0 in characters; base; reading) of its text.

    dictionary: word, reading and, if it has one, after: null, "digit" or "word" (see ANYWHERE). Of the words that begin at a
    place those after a digit go first, then those after a word, then the longest; from the left, each word that is taken
    ends before the next one begins. base is a word's leading Han characters (what follows is read as it is written), or
    the word. Null and empty words are left out; null texts give null, texts without words an empty array.
    """
    after = F.col("after") if "after" in dictionary.columns else F.lit(None).cast("string")
    kind = F.coalesce(F.when(after == "digit", AFTER_DIGIT).when(after == "word", AFTER_WORD), F.lit(ANYWHERE))
    d = dictionary.where("word <> ''").select("word", F.coalesce("reading", F.lit("")).alias("reading"), kind.alias("kind")).distinct()
    shares = max(1, -(-d.count() // words))
    if shares == 1:
        return _matched(df, text, [tuple(r) for r in d.collect()], name, True)
    # words of one share are chosen by their hash, so a share is about `words` of them
    share = F.pmod(F.xxhash64("word"), F.lit(shares))
    for i in range(shares):
        df = _matched(df, text, [tuple(r) for r in d.where(share == i).collect()], f"_found{i}", False)
    found = F.array_sort(F.concat(*[F.col(f"_found{i}") for i in range(shares)]))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(SPANS).alias("spans"))
    step = lambda s, x: F.when(x["start"] >= s["end"], F.struct((x["start"] - x["size"]).alias("end"), F.concat(s["spans"], F.array(F.struct(x["start"].alias("start"), x["base"].alias("base"), x["reading"].alias("reading")))).alias("spans"))).otherwise(s)
    return df.withColumn(name, F.aggregate(found, start, step, lambda s: s["spans"])).drop(*[f"_found{i}" for i in range(shares)])


def marked(df: DataFrame, text: str, spans: str = "spans", name: str = "marked") -> DataFrame:
    """df with its text in which each base is followed by 《reading》, as functions.scalars.ruby reads it; an empty
    reading isn't written."""
    t, s = F.col(text), F.filter(spans, lambda x: x["reading"] != "")
    end = lambda x: x["start"] + F.length(x["base"])
    parts = F.transform(s, lambda x, i: F.concat(F.substring(t, F.when(i == 0, 0).otherwise(end(F.get(s, i - 1))) + 1, x["start"] - F.when(i == 0, 0).otherwise(end(F.get(s, i - 1)))), F.lit("｜"), x["base"], F.lit("《"), x["reading"], F.lit("》")))
    last = F.when(F.size(s) > 0, end(F.element_at(s, -1))).otherwise(0)
    return df.withColumn(name, F.when(s.isNotNull(), F.concat(F.array_join(parts, ""), F.substring(t, last + 1, F.length(t)))))
