"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import Scratch, join_counted, written


def _all_stars(e: DataFrame) -> bool:
    """Whether every node hangs on one other node at most, and none that something hangs on hangs itself."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the node's least neighbour. A node may have any number of neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size")).select("a", F.least("a", "m").alias("m"), "size")
    return join_counted(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, is hung on the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
    hung = join_counted(e, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """a, b per node that is not the least of its component, b being the least. links has two columns of numbers, in any
    order, repeated at will; loops are left out, and an empty table gives no row. Each round is written to the shared
    folder, so a lost executor costs a round at most; the number of rounds grows with the logarithm of the longest chain.
    Of each round the driver learns only whether it was the last one."""
    x, y = links.columns[:2]
    scratch = Scratch(links.sparkSession, "components")
    e = scratch.written(links.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    while not _all_stars(e):
        e = scratch.written(_large_star(e).distinct(), "links")
        e = scratch.written(_small_star(e), "links")
    out = written(e, "components")
    scratch.remove()
    return out
