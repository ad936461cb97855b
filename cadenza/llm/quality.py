"""Quality rules whose thresholds adapt to each language and source, with DataFrame functions only.

Measures of each whole text are whole numbers. A group's distribution of a measure is kept as a mergeable quantile
sketch: counts of buckets that are a sixteenth of a power of two wide, so sketches of any parts add up to the sketch of
the whole and a quantile is off by a sixteenth at most. Three numbers of a sketch make its fence: the quartiles Q25 and
Q75, and N25, the lower quartile of the values above 0 (most texts have no symbol and no repeated line at all):

    above = Q75 + spread * (Q75 - Q25) + share * N25,    below = Q25 - spread * (Q75 - Q25) - share * N25

A source's numbers are shrunk towards those of its language, and these towards those of all documents, by how many
documents they come from; and a fence is at most four times the one of the level above, so that a source in which junk
prevails doesn't widen its own fence at will.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.llm.common import join_small, written

WS = r"[\x20\x09-\x0D]"

#: For each measure spread and share, in tenths, and a value up to which no text is rejected (a few words in a thousand
#: are no junk in any group): symbols, repeated lines, words in repeated windows, words like the one before and capitals
#: per thousand; mean word length in hundredths of a character, the only one that has a lower fence.
RULES = {"m_symbols": (30, 5, 50), "m_dup_lines": (30, 60, 100), "m_repeats": (30, 60, 100), "m_stutters": (30, 40, 30), "m_capitals": (30, 30, 60), "m_word_length": (60, 1, 0)}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the measures.

    A null text has no words: all counts are 0 and the base rule fails. Rows are independent.
    """
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", F.filter(F.split("text", WS + "+"), lambda w: w != ""))
    d = d.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", WS + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.expr("size(filter(w, (x, i) -> i > 0 AND x = w[i - 1]))").cast("long").alias("n_stutters"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.expr("CASE WHEN size(w) >= 8 THEN transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))) ELSE array() END").alias("windows"),
    )
    d = d.select(
        *[c for c in d.columns if c not in ("lines", "windows")],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # only texts with a repeated window need their windows in order
        F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h, i))) ELSE array() END").alias("s"),
    )
    starts = F.expr("""sort_array(transform(filter(sequence(0, size(s) - 1),
        k -> (k > 0 AND s[k - 1].h = s[k].h) OR (k < size(s) - 1 AND s[k + 1].h = s[k].h)), k -> s[k].i))""")
    d = d.withColumn("at", F.when(F.size("s") > 0, starts))
    covered = F.expr("aggregate(coalesce(at, array()), struct(0L AS n, -8 AS last), (a, i) -> struct(a.n + least(8, i - a.last) AS n, i AS last), a -> a.n)")
    d = d.withColumn("n_repeat_words", covered).drop("s", "at")
    per = lambda x, of, by=1000: F.expr(f"CASE WHEN {of} = 0 THEN 0 ELSE ({by} * {x}) div {of} END")
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "n_words").alias("m_symbols"), per("n_dup_lines", "n_lines").alias("m_dup_lines"),
        per("n_repeat_words", "n_words").alias("m_repeats"), per("n_stutters", "n_words").alias("m_stutters"), per("n_capitals", "word_chars").alias("m_capitals"),
        per("word_chars", "n_words", 100).alias("m_word_length"),
    )


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number from 0."""
    e = F.length(F.bin(v)) - 5
    return F.when(v < 32, v).otherwise(16 * e + F.call_function("shiftright", v, e))


def bucket_floor(b: Column) -> Column:
    """The least number of a bucket."""
    e = (F.floor(b / 16) - 1).cast("int")
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", b - 16 * e, e))


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bucket, n: the sketch of every measure in every group. Sketches merge by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in RULES]))
    return measured.select(*keys, each.alias("x")).groupBy(*keys, "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, n, some (values above 0), q25, q75, n25 from sketches."""
    by = [*keys, "measure"]
    every = W.partitionBy(*by)
    d = sketch.withColumns({"run": F.sum("n").over(every.orderBy("bucket")), "total": F.sum("n").over(every), "none": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(every)})
    low = bucket_floor(F.col("bucket"))
    at = lambda p: F.min(F.when(F.col("run") * 100 >= F.col("total") * p, low))
    n25 = F.min(F.when((F.col("bucket") > 0) & ((F.col("run") - F.col("none")) * 100 >= (F.col("total") - F.col("none")) * 25), low))
    return d.groupBy(*by).agg(F.max("total").alias("n"), F.max(F.col("total") - F.col("none")).alias("some"), at(25).alias("q25"), at(75).alias("q75"), F.coalesce(n25, F.lit(0)).alias("n25"))


def shrunk(d: DataFrame, above: DataFrame, keys: list[str], least: int) -> DataFrame:
    """d, the numbers of groups, each drawn towards the number that `above` has for its keys as if that had `least` more
    documents to say so; and the fence that follows, at most four times the one above."""
    u = above.select(*[F.col(c).alias(f"_{c}") for c in above.columns])
    same = F.col("measure") == F.col("_measure")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    d = d.join(F.broadcast(u) if not keys else u, same)
    mean = lambda q, n: F.expr(f"({n} * {q} + {least} * _{q}) div ({n} + {least})").alias(q)
    d = d.select(*[c for c in d.columns if c not in ("q25", "q75", "n25", *u.columns)], mean("q25", "n"), mean("q75", "n"), mean("n25", "some"), "_above")
    d = fenced(d)
    return d.withColumn("above", F.least("above", 4 * F.col("_above"))).drop("_above")


def fenced(d: DataFrame) -> DataFrame:
    rule = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, r in RULES.items() for x in (m, r[i])]), F.col("measure"))
    d = d.withColumns({"_spread": rule(0), "_share": rule(1), "_floor": rule(2)}).withColumn("_width", F.expr("(_spread * (q75 - q25) + _share * n25) div 10"))
    return d.withColumns({"above": F.greatest(F.col("q75") + F.col("_width"), F.col("_floor")), "below": F.col("q25") - F.col("_width")}).drop("_spread", "_share", "_floor", "_width")


def fences(own: DataFrame, least: int = 100) -> DataFrame:
    """lang, source, measure and the fences above and below, from the sketches of languages and sources."""
    lang = own.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = fenced(quantiles(own.groupBy("measure", "bucket").agg(F.sum("n").alias("n")), []))  # a row for each measure
    return shrunk(quantiles(own, ["lang", "source"]), shrunk(quantiles(lang, ["lang"]), whole, [], least), ["lang"], least)


def thresholds(measured: DataFrame, least: int = 100) -> DataFrame:
    """lang, source and for each measure its upper and lower fence."""
    d = fences(written(sketches(measured, ["lang", "source"]), "sketches"), least)
    pairs = [F.max(F.when(F.col("measure") == m, F.col(k))).alias(f"{k}_{m}") for m in RULES for k in ("above", "below")]
    return d.groupBy("lang", "source").agg(*pairs)


def verdicts(docs: DataFrame, least: int = 100) -> DataFrame:
    """The columns of measures() and kept. Rows with one doc_id are judged each; an empty table gives no row; null
    languages and sources are groups of their own; other columns are left out."""
    measured = written(measures(docs), "measures")
    joined = join_small(measured, thresholds(measured, least), ["lang", "source"])
    outside = F.lit(False)
    for m in RULES:
        outside |= F.col(m) > F.col(f"above_{m}")
    outside |= F.col("m_word_length") < F.col("below_m_word_length")
    return joined.select(*measured.columns, (~F.col("base_failed") & ~outside).alias("kept"))


def filtered(docs: DataFrame, least: int = 100) -> DataFrame:
    """The rows of docs that are kept, with all their columns; rows with one doc_id stay if one of them is kept."""
    keep = verdicts(docs, least).where("kept").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
