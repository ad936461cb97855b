"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A paragraph (a stretch between line ends) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors: their order doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its
vector. The vector has two parts:

* STRONG sums of independent 62-bit hashes of the whole paragraph, modulo 2^62: equal sums mean equal multisets;
* counters, two in each number and modulo 2^31: every window of four words in a row of the paragraph (all its words, if
  it has fewer) is hashed to 124 bits, and each counter counts the windows that have its bit. A word put in or left out
  changes the four windows it is in only. Twice a counter less the number of windows is a sum of signs, and the cosine of
  two documents' sign sums estimates that of their multisets of windows (standard error about 0.09).

As text a fingerprint is its numbers in hexadecimal, with dots between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.llm.common import range_cells

STRONG, PER_HASH, HASHES = 8, 31, 2
M62 = (1 << 62) - 1
PAIR = 1 | 1 << 31
#: Words in a window.
WORDS = 4
#: Numbers in a fingerprint: the strong sums, the paragraphs, the windows, the pairs of counters.
WIDTH = STRONG + 2 + PER_HASH * HASHES


def vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and lanes (the fingerprint's numbers) of every row; keys must tell the rows apart. If df is already dealt by
    some of the keys, no row moves."""
    words = lambda p: F.filter(F.split(p, " "), lambda w: w != "")
    starts = lambda w: F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    d = df.select(*keys, F.split(text, "\n").alias("_paragraphs")).withColumn("_words", F.transform("_paragraphs", words))
    windows = F.flatten(F.transform("_words", lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.lit(STRONG), F.slice(w, i, WORDS)))))
    lane = lambda i: F.aggregate("_paragraphs", F.lit(0).cast("long"), lambda a, p: (a + F.xxhash64(F.lit(i), p).bitwiseAND(F.lit(M62))).bitwiseAND(F.lit(M62)))
    # a step of its own: beside explode it would be evaluated for every window
    d = d.select(*keys, F.array(*[lane(i) for i in range(STRONG)], F.size("_paragraphs").cast("long")).alias("_strong"), windows.alias("_windows"))
    d = d.select(*keys, "_strong", F.explode_outer("_windows").alias("_h0"))
    more = [F.when(F.col("_h0").isNotNull(), F.xxhash64(F.lit(STRONG + i), "_h0")).alias(f"_h{i}") for i in range(1, HASHES)]
    d = d.select(*keys, "_strong", F.col("_h0").isNotNull().cast("long").alias("_one"), "_h0", *more)
    sums = [F.sum(F.shiftright(f"_h{i}", j).bitwiseAND(F.lit(PAIR))).alias(f"_s{i}_{j}") for i in range(HASHES) for j in range(PER_HASH)]
    d = d.groupBy(*keys, "_strong").agg(F.sum("_one").alias("_n"), *sums)
    return d.select(*keys, F.concat("_strong", F.array("_n", *[F.coalesce(s, F.lit(0).cast("long")) for s in d.columns if s.startswith("_s") and s != "_strong"])).alias("lanes"))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of all paragraphs of both."""
    return _strong_mod(F.zip_with(a, b, lambda x, y: x + y))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's, which a must contain."""
    return _strong_mod(F.zip_with(a, b, lambda x, y: x - y))


def _strong_mod(lanes: Column) -> Column:
    return F.transform(lanes, lambda x, i: F.when(i < STRONG, x.bitwiseAND(F.lit(M62))).otherwise(x))


def as_text(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.hex(x)), "."))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the estimated cosine of the multisets of windows, at least 0. A document
    without words is like no other one."""
    signs = lambda v: F.transform(F.slice(v, STRONG + 3, PER_HASH * HASHES), lambda x: F.struct(
        (2 * x.bitwiseAND(F.lit((1 << 31) - 1)) - F.get(v, STRONG + 1)).cast("double").alias("l"), (2 * F.shiftright(x, 31) - F.get(v, STRONG + 1)).cast("double").alias("h")))
    dot = F.aggregate(F.zip_with(signs(a), signs(b), lambda x, y: F.struct((x["l"] * y["l"] + x["h"] * y["h"]).alias("ab"), (x["l"] * x["l"] + x["h"] * x["h"]).alias("aa"), (y["l"] * y["l"] + y["h"] * y["h"]).alias("bb"))),
                      F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb")),
                      lambda t, x: F.struct((t["ab"] + x["ab"]).alias("ab"), (t["aa"] + x["aa"]).alias("aa"), (t["bb"] + x["bb"]).alias("bb")),
                      lambda t: F.when((t["aa"] == 0) | (t["bb"] == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t["ab"] / F.sqrt(t["aa"] * t["bb"])))))
    return F.when(a == b, 1.0).otherwise(dot)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, lanes, fingerprint of every row. A null text is empty: one empty paragraph, no window."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    d = vectors(d, ["_row", "doc_id"], "text")
    return d.select("doc_id", "lanes", as_text(F.col("lanes")).alias("fingerprint"))


def against_edited(docs: DataFrame, rows: int = 256) -> DataFrame:
    """Every row's fingerprint against that of its edited text and of the next document in descending doc_id order
    (after the last: the first): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document.
    Documents are dealt by ranges of doc_id, about `rows` in each, so that neighbours meet; the largest of each range is
    also sent to the range that follows it. Texts move once. Null texts are empty; rows with one doc_id follow each
    other in descending order of their texts; null ids come last; a lone document is its own next one.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cell, cells = range_cells(d, "doc_id", rows)
    d = d.withColumn("_cell", cell)
    largest = F.broadcast(d.groupBy("_cell").agg(F.max("doc_id").alias("_max")))  # a row for each range, 65,536 at most
    both = F.when(F.col("doc_id").eqNullSafe(F.col("_max")), F.array(F.struct(F.col("_cell").alias("c"), F.lit(0).alias("g")), F.struct(F.pmod(F.col("_cell") + 1, F.lit(cells)).cast("int").alias("c"), F.lit(1).alias("g"))))
    d = d.join(largest, "_cell").select("doc_id", "text", F.explode(F.coalesce(both, F.array(F.struct(F.col("_cell").alias("c"), F.lit(0).alias("g"))))).alias("x"))
    d = d.select("doc_id", "text", F.col("x.c").alias("_cell"), F.col("x.g").alias("_guard"))
    order = W.partitionBy("_cell").orderBy("_guard", F.desc_nulls_last("doc_id"), F.desc("text"))
    d = d.withColumns({"_next": F.lead("text").over(order), "_row": F.row_number().over(order), "n_chars": F.length("text").cast("long")})
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left(F.coalesce("_next", F.lit("")), half))
    d = d.select("_cell", "_row", "_guard", "doc_id", "n_chars", "text", edited.alias("_edited"))
    d = d.withColumn("edited_sha256", F.sha2("_edited", 256))
    kinds = F.filter(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t"))), lambda x: (x["k"] == 0) | (F.col("_guard") == 0))
    d = d.select("_cell", "_row", "_guard", "doc_id", "n_chars", "edited_sha256", F.explode(kinds).alias("x"))
    keys = ["_cell", "_row", "_guard", "doc_id", "n_chars", "edited_sha256", "_kind"]
    d = vectors(d.select(*keys[:-1], F.col("x.k").alias("_kind"), F.col("x.t").alias("_text")), keys, "_text")
    order = W.partitionBy("_cell").orderBy("_row", "_kind")  # the text, its edited text, the next text
    d = d.withColumns({"_e": F.lead("lanes", 1).over(order), "_n": F.lead("lanes", 2).over(order)}).where("_kind = 0 AND _guard = 0")
    return d.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("_e")).alias("edited_fingerprint"),
                    likeness(F.col("lanes"), F.col("_e")).alias("near_edited"), likeness(F.col("lanes"), F.col("_n")).alias("near_next"))
