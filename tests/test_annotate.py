"""Annotations against a plain loop over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import annotate as A, scalars as X
from cadenza.plans import registry


def plain(text, entries):
    """Place by place: of the words that may stand there the one that goes first."""
    if text is None:
        return None
    out, i = [], 0
    while i < len(text):
        before = text[:i].rstrip(" 　")[-1:]
        may = []
        for word, reading, after in entries:
            ok = after is None or after == "digit" and before.isdecimal() or after == "word" and before and A.is_word(before)
            if word and ok and text.startswith(word, i):
                may.append((-A.KINDS.get(after, 0), -len(word), word, reading or ""))
        if may:
            _, _, word, reading = min(may)
            han = next((k for k, c in enumerate(word) if not A.is_han(c)), len(word))
            out.append((i, word[:han] or word, reading))
            i += len(word)
        else:
            i += 1
    return out


WORDS = [("歌", "うた", None), ("歌う", "うた", None), ("歌手", "かしゅ", None), ("手", "て", None), ("人", "ひと", None), ("人", "にん", "digit"), ("人気", "にんき", None), ("中", "なか", None), ("中", "ちゅう", "word"), ("曲目", "きょくもく", "digit"), ("曲", "きょく", None), ("", "x", None), (None, "y", None), ("a", None, None), ("ab", "AB", None)]


def texts():
    rng = random.Random(6)
    return [None, "", "歌手が歌う", "3 人", "３人気", "人中中", "カラオケ中", "2　曲目", "歌" * 3000] + ["".join(rng.choice("歌う手人気中曲目3 　カab") for _ in range(rng.randint(0, 40))) for _ in range(300)]


@pytest.mark.parametrize("words", [500_000, 4])
def test_annotations_equal_a_plain_loop(spark, words):
    t = texts()
    d = spark.createDataFrame(list(enumerate(t)), "i int, t string").withColumn("start", F.lit("s")).repartition(3)
    dictionary = spark.createDataFrame(WORDS, "word string, reading string, after string")
    got = A.annotated(d, "t", dictionary, words=words)
    spans = {r.i: None if r.spans is None else [tuple(x) for x in r.spans] for r in got.collect()}
    assert spans == {i: plain(x, WORDS) for i, x in enumerate(t)}
    back = A.marked(got, "t").select("t", "marked", X.plain(F.col("marked")).alias("plain")).collect()
    assert all(r.plain == r.t for r in back) and any("《" in (r.marked or "") for r in back)


def test_no_words_and_no_texts(spark):
    dictionary = spark.createDataFrame(WORDS, "word string, reading string, after string")
    d = spark.createDataFrame([(1, "歌"), (2, None)], "i int, t string")
    assert A.annotated(d.limit(0), "t", dictionary).count() == 0
    assert [r.spans for r in A.annotated(d, "t", dictionary.limit(0).drop("after")).orderBy("i").collect()] == [[], None]


def test_a_hundred_thousand_words(spark):
    rng = random.Random(8)
    letters = "abcdefgh"
    words = list({"".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(110_000)})[:100_000]
    known = {w: w[::-1] for w in words}
    t = ["".join(rng.choice(letters + " ") for _ in range(300)) for _ in range(60)]
    dictionary = spark.createDataFrame(list(known.items()), "word string, reading string")
    got = {r.i: [tuple(x) for x in r.spans] for r in A.annotated(spark.createDataFrame(list(enumerate(t)), "i int, t string"), "t", dictionary).collect()}
    for i, x in enumerate(t):
        want, at = [], 0
        while at < len(x):
            n = next((n for n in range(7, 3, -1) if x[at : at + n] in known and at + n <= len(x)), 1)
            if n > 1:
                want.append((at, x[at : at + n], known[x[at : at + n]]))
            at += n
        assert got[i] == want


def test_the_query_equals_a_plain_loop(spark):
    folder = "/root/testdata/sf0.001"
    words = {w for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for w in (r.text or "").split(" ") if len(w) > 3}
    longest = max(map(len, words))
    got = {r.doc_id: (r.n_spans, r.n_chars, r.n_read) for r in registry.QUERIES["annotated_words"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        spans, at, text = [], 0, r.text or ""
        while at < len(text):
            n = next((n for n in range(min(longest, len(text) - at), 3, -1) if text[at : at + n] in words), 1)
            if n > 1:
                spans.append(text[at : at + n])
            at += n
        assert got[r.doc_id] == (len(spans), sum(map(len, spans)), len(set(spans)))
