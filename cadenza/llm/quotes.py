"""Messages linked by what they quote, with DataFrame functions only.

A line that begins with `>` marks is quoted, as deep as it has marks. Lines are normalised (marks and outer space off,
inner space single, lower case) and hashed. A passage is a run of quoted lines of one depth, blank ones aside; its hash,
over its lines' hashes, is joined to those of equally long runs of own lines of the earlier messages of its conversation,
of which the latest is its origin. A passage that no message has as a whole (it was shortened, or put together) comes
from the message that most of its lines are linked to, each to the latest earlier message that has it as its own. A
message replies to the origin of most of its outermost quoted lines (ties: the latest); one that quotes nothing known
replies to the message before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.llm.common import Scratch, join_small, written

MARKS = r"^\s*((?:>\s?)+)"


def carried(df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = 256) -> DataFrame:
    """df with the latest non-null value of an earlier row (a smaller `order`) of the same keys, nulls being equal.
    Rows are dealt by keys and spans of `order`, so a hot key spreads; only one row a span is ordered by key alone."""
    key = [F.coalesce(F.xxhash64(*keys), F.lit(0)) if keys else F.lit(0), *keys]
    d = df.withColumns({"_key": F.struct(*key), "_span": F.floor(F.col(order) / span), "_value": value})
    own = F.last("_value", ignorenulls=True).over(W.partitionBy("_key", "_span").orderBy(order).rangeBetween(W.unboundedPreceding, -1))
    ends = d.where("_value IS NOT NULL").groupBy("_key", "_span").agg(F.max_by("_value", order).alias("_end"))
    spans = d.select("_key", "_span").distinct().join(ends, ["_key", "_span"], "left")
    before = F.last("_end", ignorenulls=True).over(W.partitionBy("_key").orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select(F.col("_key").alias("_k"), F.col("_span").alias("_s"), before.alias("_before"))
    d = d.withColumn("_own", own).join(spans, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s")), "left")
    return d.withColumn(name, F.coalesce("_own", "_before")).drop("_key", "_span", "_value", "_own", "_before", "_k", "_s")


def _row(text: str | Column) -> Column:
    """128 bits that tell messages apart."""
    return F.md5(F.to_json(F.struct("conv_id", "turn", "role", (F.col(text) if isinstance(text, str) else text).alias("t")), {"ignoreNullFields": "false"}))


def lines(messages: DataFrame) -> DataFrame:
    """_row, conv_id, turn, role, pos, level, line (without marks), hash (null for blank lines) of every line."""
    d = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_row", _row("_text"))
    d = d.select("_row", "conv_id", "turn", "role", F.posexplode(F.split("_text", "\r?\n")).alias("pos", "_raw"))
    marks = F.regexp_extract("_raw", MARKS, 1)
    d = d.withColumn("level", F.length(F.regexp_replace(marks, r"[^>]", "")))
    d = d.withColumn("line", F.when(F.col("level") > 0, F.regexp_replace("_raw", MARKS, "")).otherwise(F.col("_raw")))
    norm = F.lower(F.trim(F.regexp_replace("line", r"\s+", " ")))
    return d.withColumn("hash", F.when(norm != "", F.xxhash64(norm))).drop("_raw")


def linked_lines(messages: DataFrame, span: int = 256, found: DataFrame | None = None) -> DataFrame:
    """lines() of quotes with origin, the turn of the latest earlier message that has the line as its own. Lines of null
    conversations or turns are linked to nothing. found: lines() of the messages, if they are at hand."""
    d = (lines(messages) if found is None else found).where("hash IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    return carried(d, ["conv_id", "hash"], "turn", F.when(F.col("level") == 0, F.col("turn")), "origin", span).where("level > 0").dropDuplicates(["_row", "pos"])


def passages(messages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """_row, conv_id, turn, passage, level, n_lines, n_linked, hash (of the normalised passage), whole (whether all of it
    is linked as one), origin per quoted passage. found: as linked_lines()."""
    found = lines(messages) if found is None else found
    d = linked_lines(messages, found=found)
    by = W.partitionBy("_row").orderBy("pos")
    new = (F.col("level") != F.coalesce(F.lag("level").over(by), F.lit(0))).cast("int")
    d = d.withColumn("_new", new).withColumn("passage", F.sum("_new").over(by))
    keys = ["_row", "conv_id", "turn", "passage", "level"]
    votes = d.groupBy(*keys, "origin").agg(F.count("*").alias("_n"), F.collect_list(F.struct("pos", "hash")).alias("_lines"))
    voted = F.max_by("origin", F.struct(F.when(F.col("origin").isNotNull(), F.col("_n")).otherwise(0), F.col("origin")))
    own = votes.groupBy(*keys).agg(voted.alias("_voted"), F.sum("_n").alias("n_lines"), F.sum(F.when(F.col("origin").isNotNull(), F.col("_n")).otherwise(0)).alias("_some"), F.flatten(F.collect_list("_lines")).alias("_lines"))
    hashes = F.transform(F.sort_array("_lines"), lambda x: x["hash"])
    p = own.select(*keys, "n_lines", "_voted", "_some", F.xxhash64(hashes).alias("hash"))
    k = F.col("k").cast("int")
    # Runs of own lines, of the lengths that the conversation's passages have. Few conversations have any, and the lines of
    # a large one stay where they are.
    lengths = p.groupBy("conv_id").agg(F.collect_set("n_lines").alias("_ks"))
    mine = found.where("level = 0 AND hash IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("_row", "conv_id", "turn").agg(F.sort_array(F.collect_set(F.struct("pos", "hash"))).alias("_own"))
    mine = join_small(mine, lengths, ["conv_id"]).withColumn("k", F.explode("_ks")).where("k <= size(_own)").withColumn("_own", F.transform("_own", lambda x: x["hash"]))
    runs = mine.select("conv_id", "turn", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("_own") - k + 1), lambda i: F.xxhash64(F.slice("_own", i, k)))).alias("hash")).distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in p.dtypes if c not in ("conv_id", "turn", "hash")]
    both = p.withColumn("k", F.col("n_lines")).withColumn("_quoted", F.lit(True)).unionByName(runs.select("conv_id", "turn", "hash", "k", *none, F.lit(False).alias("_quoted")))
    d = carried(both, ["conv_id", "k", "hash"], "turn", F.when(~F.col("_quoted"), F.col("turn")), "_whole").where("_quoted")
    whole = F.col("_whole").isNotNull()
    return d.select(*keys, "n_lines", F.when(whole, F.col("n_lines")).otherwise(F.col("_some")).alias("n_linked"), "hash", whole.alias("whole"), F.coalesce("_whole", "_voted").alias("origin"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, n_linked (quoted lines that are not blank, and those of them
    with an origin), max_level, reply_to (a turn; null for a conversation's first message). Ordered by turn, a reply
    always follows what it replies to. Null texts are empty. Equal rows are one message and come once for each copy; an
    empty table gives no row; other columns are left out.
    """
    d = lines(messages)
    own = d.groupBy("_row").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("_own"),
        F.max("level").alias("max_level"))
    narrow = written(d.select("_row", "conv_id", "turn", "pos", "level", "hash"), "lines")
    votes = passages(messages, narrow).groupBy("_row", "origin").agg(F.sum("n_lines").alias("_n"), F.sum("n_linked").alias("_linked"), F.min("level").alias("_level"))
    quoted = votes.groupBy("_row").agg(
        F.sum("_n").alias("n_quoted"), F.sum("_linked").alias("n_linked"),
        F.max_by("origin", F.when(F.col("origin").isNotNull(), F.struct(-F.col("_level"), F.col("_n"), F.col("origin")))).alias("_quoted"))
    m = messages.select("conv_id", "turn", "role", _row(F.coalesce("text", F.lit(""))).alias("_row"))
    m = carried(m, ["conv_id"], "turn", F.col("turn"), "_previous")
    m = m.join(own, "_row", "left").join(quoted, "_row", "left")
    zero = F.lit(0).cast("long")
    text = F.regexp_replace(F.regexp_replace("_own", r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return m.select("conv_id", "turn", "role", text.alias("text"), F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"), "max_level", F.coalesce("_quoted", "_previous").alias("reply_to"))


def threads(found: DataFrame) -> DataFrame:
    """found (from conversations()) with thread, the turn that its chain of replies begins with, and depth, the replies up
    to that. Every round doubles the stretch that is known of each chain and is written; a conversation ordered by
    thread, turn has every thread in reply order. Messages without a conversation or turn are threads of their own."""
    scratch = Scratch(found.sparkSession, "threads")
    hop = found.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up"))
    hop = scratch.written(hop.select("conv_id", "turn", F.coalesce("up", "turn").alias("top"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("far"), F.col("up").isNull().alias("done")), "hops")
    while not hop.where("NOT done").isEmpty():
        nxt = hop.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("_top"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        # what has come to its thread's beginning doesn't move any more, so no top is asked for by all of a conversation
        far = hop.where("NOT done").join(nxt, ["conv_id", "top"], "left")
        far = far.select("conv_id", "turn", F.coalesce("_top", "top").alias("top"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.coalesce("_done", F.lit(True)).alias("done"))
        hop = scratch.written(hop.where("done").unionByName(far), "hops")
    ends = written(hop.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("top").alias("_top"), "far"), "threads")
    scratch.remove()
    d = found.join(ends, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    return d.select(*found.columns, F.coalesce("_top", "turn").alias("thread"), F.coalesce("far", F.lit(0)).alias("depth"))
