"""Merkle manifest of a corpus: a tree per language, a tree of the languages' roots, and each document's proof.

A node's digest stands in the row of its first leaf. At level l a node's siblings are 1, 2, ... times arity ** l rows away,
so lag and lead columns of fixed offsets, masked by the node's slot in its run and by the run's length, hold them, and the
rows of first children hash the parents. Windows span aligned blocks of `arity ** depth` leaves, never a language: a block is
a whole subtree, and the blocks' digests are the leaves of the next round, until one is left in each language. The proofs
then come down again, from the languages' tree through the blocks to the leaves, by joins in which a key has a block's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cadenza.llm.common import Scratch, range_cells, written

#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def field(c: Column) -> Column:
    """`-` for null, else its UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings of its path lead to."""
    return F.aggregate(path, start, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def numbered(df: DataFrame, cell: Column, order: list[str]) -> DataFrame:
    """df with pos, from 0 within each `tree` by `order`, and n, the tree's rows. Cells ascend with the order; only their
    counts are summed along a tree, and rows are numbered within a cell."""
    df = df.withColumn("cell", cell)
    counts = df.groupBy("tree", "cell").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    at = Window.partitionBy("tree", "cell").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("at", F.row_number().over(at) - 1).join(counts, ["tree", "cell"]).withColumn("pos", F.col("base") + F.col("at")).drop("cell", "at", "base")


def blocks(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """nodes (tree, pos, n, digest, ...) with the path of each within its block of arity ** depth nodes and, in a block's
    first row, `top`: the block's own digest. Levels that a tree of n nodes doesn't have are left out."""
    block = F.expr(f"pos div {arity**depth}")
    w = Window.partitionBy("tree", "block").orderBy("pos")
    d = nodes.withColumn("block", block).withColumn("top", F.col("digest"))
    for level in range(depth):
        step = arity**level
        node = F.expr(f"pos div {step}")
        slot = F.pmod(node, F.lit(arity))
        run = F.least(F.lit(arity), F.ceil(F.col("n") / step) - node + slot)
        held = (F.pmod(F.col("pos"), F.lit(step)) == 0) & (F.col("n") > step)
        before = [F.when(slot >= k, F.lag("top", k * step).over(w)) for k in range(arity - 1, 0, -1)]
        after = [F.when(slot + k < run, F.lead("top", k * step).over(w)) for k in range(1, arity)]
        d = d.withColumn(f"s{level}", F.when(held, F.struct(F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after"))))
        parent = F.sha2(F.concat("top", F.col(f"s{level}.after")), 256)
        d = d.withColumn("top", F.when(held & (slot == 0), parent).when(F.col("n") <= step, F.col("top")))
    # A node's siblings are its leaves' too: those of the last node that began at or before a leaf.
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = [F.last(f"s{level}", ignorenulls=True).over(so_far) for level in range(depth)]
    return d.select(*nodes.columns, "block", "top", F.array_compact(F.array(*carried)).cast(PATH).alias("path"))


def proofs(nodes: DataFrame, above, scratch: Scratch, arity: int, depth: int) -> DataFrame:
    """nodes with `path`, siblings level by level up to the root of all, and subroot, their tree's digest.

    above: makes, of the trees' roots (tree, digest), the same with each root's own path.
    """
    rounds = []
    while True:
        rounds.append(scratch.written(blocks(nodes, arity, depth), "blocks"))
        nodes = rounds[-1].where(F.pmod(F.col("pos"), F.lit(arity**depth)) == 0).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / arity**depth).alias("n"), F.col("top").alias("digest"))
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    upper = above(nodes.select("tree", "digest")).select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), F.col("path").alias("rest"))
    for one in reversed(rounds):
        one = one.join(upper, ["tree", "block"]).withColumn("path", F.concat("path", "rest")).drop("rest")
        upper = one.select("tree", F.col("pos").alias("block"), "subroot", F.col("path").alias("rest"))
    return one.drop("block", "top", "n", "pos")


def manifest(docs: DataFrame, found: Column | None = None, arity: int = 2, depth: int = 10, rows: int = 5000) -> DataFrame:
    """Per row of docs: doc_id, leaf, found, path (siblings before and after, from the leaf up), subroot, root.

    found: a digest to carry along, of what was found in the row's place, say (default: the leaf). Leaves ascend within a language by doc_id,
    null first; rows that repeat a doc_id by their leaf. Columns other than FIELDS are left out, an empty table gives no rows.
    A run of one node is hashed alone; a tree of one leaf has that leaf as its root. Ranges of doc_id of about `rows` rows
    are numbered each by itself, so many rows of one doc_id would be sorted by one task.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "merkle")
    try:
        # A string that is null or has a language, in the order of the languages' bytes.
        tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
        d = docs.select("doc_id", tree.alias("tree"), leaf().alias("digest"), (leaf() if found is None else found).alias("found"))
        d = scratch.written(d, "leaves")
        cell, _ = range_cells(d, "doc_id", rows)
        roots: list[str] = []

        def languages(subroots: DataFrame) -> DataFrame:
            top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")

            def alone(root: DataFrame) -> DataFrame:
                roots.extend(r.digest for r in root.collect())  # one row
                return root.withColumn("path", F.array().cast(PATH))

            top = numbered(top, F.substring("name", 1, 3), ["name"])
            return proofs(top, alone, scratch, arity, depth).select(F.col("name").alias("tree"), "digest", "path")

        d = numbered(d, F.coalesce(cell, F.lit(-1)), ["doc_id", "digest"])
        out = proofs(d, languages, scratch, arity, depth)
        root = F.lit(roots[0]) if roots else F.lit(None).cast("string")
        return written(out.select("doc_id", F.col("digest").alias("leaf"), "found", "path", "subroot", root.alias("root")), "manifest")
    finally:
        scratch.remove()


def audit(docs: DataFrame, tamper: Column, **how) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified (it equals root).

    folded_root is made from a row's own siblings and its leaf, or, where `tamper` holds, the leaf of the same row with
    n_chars + 1; null n_chars stays null, so such a row verifies, and so does any other that isn't changed.
    """
    changed = F.when(tamper, leaf(n_chars=F.try_add("n_chars", F.lit(1)))).otherwise(leaf())
    m = manifest(docs, changed, **how)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    m = m.withColumn("folded_root", folded(F.col("found"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def every_seventh() -> Column:
    """The rows that the query tampers with: 7 divides crc32 of the decimal doc_id; a null id is none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


#: crc32 of a doc_id in DuckDB's SQL, by the table of its reflected polynomial.
_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)))"
_CRC32 = "xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: xor(a >> 8, t[xor(a, c) % 256 + 1]), 4294967295))"

#: Both trees by recursion over their levels, proofs by joins, the folded root by recursion along each proof.
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, n_chars, coalesce('=' || lang, '') AS tree,
         sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
         sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || tail) AS changed
  FROM (SELECT doc_id, lang, n_chars,
          coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
          coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low(tree, lvl, pos, n, digest) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
subroots AS (SELECT tree, lvl AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS seat, count(*) OVER () AS trees FROM low WHERE n = 1),
high(lvl, pos, n, digest) AS (
  SELECT 0, seat, trees, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT tree, low.lvl, pos AS node, n, digest FROM low WHERE n > 1),
side AS (
  SELECT p.doc_id, p.tree, p.pos, s.lvl, (p.pos >> s.lvl) % 2 AS slot, coalesce(b.digest, '') AS sib
  FROM placed p JOIN (SELECT DISTINCT tree, lvl FROM steps) s USING (tree) LEFT JOIN steps b ON b.tree = p.tree AND b.lvl = s.lvl AND b.node = xor(p.pos >> s.lvl, 1)
  UNION ALL
  SELECT p.doc_id, p.tree, p.pos, r.height + s.lvl, (r.seat >> s.lvl) % 2, coalesce(b.digest, '')
  FROM placed p JOIN subroots r USING (tree) JOIN (SELECT DISTINCT lvl FROM high WHERE n > 1) s ON true LEFT JOIN high b ON b.n > 1 AND b.lvl = s.lvl AND b.pos = xor(r.seat >> s.lvl, 1)),
paths AS (SELECT tree, pos, sha256(string_agg(sib, '' ORDER BY lvl)) AS proof, list(struct_pack(slot := slot, sib := sib) ORDER BY lvl) AS path FROM side GROUP BY tree, pos),
started AS (
  SELECT p.*, coalesce(proof, sha256('')) AS proof_sha256, coalesce(path, []) AS path, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN changed ELSE leaf END AS start
  FROM (SELECT *, {_CRC32} AS crc FROM placed, (SELECT {_TABLE} AS t)) p LEFT JOIN paths USING (tree, pos)),
walk(tree, pos, k, acc) AS (
  SELECT tree, pos, 1, start FROM started
  UNION ALL
  SELECT w.tree, w.pos, k + 1, sha256(CASE WHEN s.path[k].slot = 1 THEN s.path[k].sib || acc ELSE acc || s.path[k].sib END)
  FROM walk w JOIN started s ON s.tree = w.tree AND s.pos = w.pos WHERE k <= len(s.path))
SELECT doc_id, leaf, r.digest AS subroot, t.digest AS root, proof_sha256, w.acc AS folded_root, w.acc = t.digest AS verified
FROM started s JOIN subroots r USING (tree) JOIN high t ON t.n = 1 JOIN walk w ON w.tree = s.tree AND w.pos = s.pos AND w.k = len(s.path) + 1"""
