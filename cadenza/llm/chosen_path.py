"""Near-duplicates by a chosen-path set similarity join.

Every text is a set of word shingles; equal sets are one member. Each of several independent trees sends a member down
the path of its minwise tokens at the coordinates chosen for that path, so a node holds members that agree on all of
them, and two members of similarity s part at a coordinate with probability 1 - s. A path begins with LEVELS coordinates,
so that members which share a passage and little else rarely meet. A node of one member is done, and one of at most BLOCK
members is compared exhaustively, once if several trees have it.

In a larger node links are sought before anything branches: its members are dealt at random into cells of BLOCK, each of
which is compared exhaustively, and linked members take a common label; a few such rounds leave near copies of one text
with one label. Members of one label need not be compared again, so a node of one label is done. If at most COMPARED
members are outside the commonest label, they are compared with all of the node, in blocks (nodes of one commonest label
as one node, where that is fewer pairs); else the node branches by one coordinate, in 1 / similarity children on the average, and its children go the same way. A member's rows are multiplied
by about COMPARED / WIDE at most where it is compared, and by 1 / similarity a level where it branches. Nothing is dropped:
after DEPTH levels what is outside the commonest label is compared with all of its node all the same.

Candidates are found by 128 minwise tokens and confirmed on the full sets. The links' components are the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import BROADCAST_ROWS, Scratch, corpus, join_counted, runs, slices, written
from cadenza.llm.components import components

#: Trees, all alike, and coordinates that their paths begin with: a pair of similarity 0.8 whose nodes don't branch is
#: missed by all ten with probability 4e-5, however large the nodes are.
TREES, LEVELS = 10, 2
#: Members of a node that is compared as a whole and of a random cell; of either side of a block where what is outside a
#: label meets the rest; outside a label at most for that; levels; rounds of cells.
BLOCK, WIDE, COMPARED, DEPTH, ROUNDS = 256, 512, 8192, 10, 3


def least_equal(similarity: float) -> int:
    """How many of 128 minwise tokens must be equal for a pair to be held against its full sets: what the similarity
    leads to, less four standard errors (a pair just at the similarity is missed with probability 3e-5)."""
    return int((similarity - 4 * (similarity * (1 - similarity) / COORDINATES) ** 0.5) * COORDINATES)


def trees(similarity: float) -> int:
    """TREES, or as many more as a pair just at a lower similarity needs to be missed as rarely."""
    return max(TREES, math.ceil(TREES * math.log(1 - 0.8**LEVELS) / math.log(1 - similarity**LEVELS))) if similarity < 1 else TREES


COORDINATES = 128
_random = np.random.RandomState(20240229)
ODD = _random.randint(0, 2**32, COORDINATES, np.uint32) | np.uint32(1)
FLIP = _random.randint(0, 2**32, COORDINATES, np.uint32)
STEP = np.uint64(0x9E3779B97F4A7C15)


def step(i: int) -> np.uint64:
    return np.uint64(i * int(STEP) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and every ASCII white-space character as a space, other characters as they are."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]].copy() if at[-1] else np.empty(0, np.uint8)
    raw[(raw >= 65) & (raw <= 90)] += 32
    raw[(raw >= 9) & (raw <= 13)] = 32
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(raw.tobytes())])


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after another, and the bounds of each."""
    parts = pc.split_pattern(folded(texts), " ")
    at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    real = np.fromiter((w != "" for w in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
    codes = coded.indices.to_numpy()
    keep = real[codes]  # texts that begin or end with white space have an empty word there
    ends = np.concatenate([[0], np.cumsum(keep)])[at]
    w = hashes[codes[keep]]
    n = np.diff(ends)
    k = np.maximum(1, n - words + 1) * (n > 0)
    first = np.repeat(ends[:-1], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    long = np.repeat(np.minimum(n, words), k)
    h = long.astype(np.uint64)
    for i in range(words):
        inside = i < long
        h = np.where(inside, mixed(h * STEP + w[np.minimum(first + i, len(w) - 1)]), h) if len(w) else h
    cuts = np.concatenate([[0], np.cumsum(k)])
    sets = [np.unique(h[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return (np.concatenate(sets) if sets else h), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each nonempty set and coordinate the least hash."""
    full = at[:-1][np.diff(at) > 0]
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(full), COORDINATES), np.uint32)
    if len(full):
        for c in range(COORDINATES):
            out[:, c] = np.minimum.reduceat((x ^ FLIP[c]) * ODD[c], full)
    return out


def roots(least: np.ndarray, n: int) -> np.ndarray:
    """Each member's node in each of n trees, as 32 bits: the path begins with a coordinate of the tree's own and LEVELS - 1
    chosen ones."""
    out, i = np.empty((len(least), n), np.uint32), np.arange(len(least))
    for t in range(n):
        key = mixed(least[:, t % COORDINATES].astype(np.uint64) + step(t + 1))
        for _ in range(LEVELS - 1):
            path = mixed(key + step(1))
            c = (mixed(path + np.uint64(1)) % np.uint64(COORDINATES)).astype(int)
            key = mixed(path + least[i, c].astype(np.uint64))
        out[:, t] = key >> np.uint64(32)
    return out


def signatures(docs: DataFrame, words: int, n: int = TREES) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the set; null for an empty one), roots and tokens (binary: the nodes in n
    trees, and one byte of each minwise hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, at = shingle_sets(part.column("text"), words)
            full, raw, count = minima(sets, at), sets.tobytes(), np.diff(at)
            short = np.ascontiguousarray(full.view(np.uint8).reshape(len(full), COORDINATES, 4)[:, :, 0])
            nodes, digests, first, tokens, k = roots(full, n), [], [], [], 0
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                digests.append(hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() if y > x else None)
                first.append(nodes[k].tobytes() if y > x else None)
                tokens.append(short[k].tobytes() if y > x else None)
                k += y > x
            binary = [pa.array(c, pa.binary()) for c in (digests, first, tokens)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count), *binary], ["doc_id", "n_shingles", "digest", "roots", "tokens"])

    return corpus(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, roots binary, tokens binary")


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _roots(members: DataFrame) -> DataFrame:
    """key, tree, sid: each member's node in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                nodes = _matrix(b.column("roots"), np.uint32).T
                n = len(nodes)
                tree = np.repeat(np.arange(n, dtype=np.int32), b.num_rows)
                keys = (tree.astype(np.int64) << 32) + nodes.reshape(-1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tree), pa.array(np.tile(b.column("sid").to_numpy(), n))], ["key", "tree", "sid"])

    return members.select("sid", "roots").mapInArrow(run, "key long, tree int, sid long")


def _children(rows: DataFrame, similarity: float) -> DataFrame:
    """The nodes below those of key, tree, sid, label, tokens, each by a coordinate that it chooses: 1 / similarity of
    them on the average."""
    whole, part = divmod(1 / similarity, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m, key, i = _matrix(b.column("tokens"), np.uint8), b.column("key").to_numpy().astype(np.uint64), np.arange(b.num_rows)
                keys, kept = [], []
                for r in range(int(whole) + 1):
                    path = mixed(key + step(r + 1))
                    c = (mixed(path + np.uint64(1)) % np.uint64(COORDINATES)).astype(int)
                    kept.append(i[(r < whole) | (mixed(path + np.uint64(2)) < np.uint64(int(part * (2**64 - 1))))])
                    keys.append((mixed(path + m[i, c]) >> np.uint64(8))[kept[-1]])
                kept = pa.array(np.concatenate(kept))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), *[b.column(c).take(kept) for c in ("tree", "sid", "label")]], ["key", "tree", "sid", "label"])

    return rows.mapInArrow(run, "key long, tree int, sid long, label long")


def _open(rows: DataFrame) -> DataFrame:
    """key, tree, size, common (the commonest label), outside (the members of other labels) of nodes of several labels."""
    d = rows.groupBy("key", "tree", "label").agg(F.count("*").alias("_n"))
    d = d.groupBy("key", "tree").agg(F.sum("_n").alias("size"), F.max("_n").alias("_most"), F.max_by("label", F.struct("_n", "label")).alias("common"))
    return d.select("key", "tree", "size", "common", (F.col("size") - F.col("_most")).alias("outside")).where("outside > 0")


def _alike_once(rows: DataFrame) -> DataFrame:
    """The rows (key, sid, label) of nodes of at most BLOCK members, of nodes with the same members those of one."""
    members = [F.bit_xor(F.xxhash64("sid", F.lit(i))) for i in range(2)]
    sets = rows.groupBy("key").agg(F.count("*").alias("_n"), members[0].alias("_a"), members[1].alias("_b"))
    return rows.join(sets.groupBy("_n", "_a", "_b").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _as_one(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (key, sid, label, size, common, outside), those of nodes with one commonest label as one node where that is
    fewer pairs of an outside member and any other. A member has one label in all of its nodes."""
    rows = scratch.written(rows, "near")
    nodes = rows.select("key", "common", "size", "outside").distinct().groupBy("common").agg(F.count("*").alias("nodes"), F.sum(F.col("size").cast("double") * F.col("outside")).alias("pairs"))
    one = scratch.written(rows.select("common", "sid", "label").distinct(), "one")
    sizes = one.groupBy("common").agg(F.count("*").alias("size"), F.sum((F.col("label") != F.col("common")).cast("long")).alias("outside"))
    fewer = scratch.written(sizes.join(nodes.where("nodes > 1"), "common").where("double(size) * outside <= pairs").select("common", "size", "outside"), "fewer")
    rest = rows.join(fewer.select("common"), "common", "left_anti").select("key", "sid", "label", "size", "common", "outside")
    return rest.unionByName(join_counted(one, fewer, "common").select(F.xxhash64("common").alias("key"), "sid", "label", "size", "common", "outside"))


def _outside_against_all(rows: DataFrame) -> DataFrame:
    """Blocks in which every member outside its node's commonest label (side 0) meets every other one (side 1)."""
    k, l = (F.ceil(F.col(c) / WIDE).cast("int") for c in ("size", "outside"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.where("label <> common").select("key", "sid", "label", F.lit(0).alias("side"), F.pmod(F.xxhash64("sid"), l).cast("int").alias("i"), every(k).alias("j"))
    right = rows.select("key", "sid", "label", F.lit(1).alias("side"), every(l).alias("i"), F.pmod(F.xxhash64("sid", F.lit(1)), k).cast("int").alias("j"))
    return left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("block"), "sid", "label", "side")


def _search(members: DataFrame, sets: Sets, similarity: float, scratch: Scratch) -> DataFrame:
    """a, b: links that connect what is to be connected."""
    nodes = scratch.written(_roots(members).withColumn("label", F.col("sid")), "nodes")
    own, blocks, links = F.col("sid"), [], []
    for depth in range(DEPTH + 1):
        sizes = scratch.written(nodes.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        shared = scratch.written(join_counted(nodes, sizes, "key"), "shared")
        small = shared.where(F.col("size") <= BLOCK).select("key", "sid", "label")
        blocks.append(_alike_once(small).select(F.col("key").alias("block"), "sid", "label", F.lit(0).alias("side")))
        rows = shared.where(F.col("size") > BLOCK).drop("size")
        if rows.isEmpty():
            break
        ids = scratch.written(rows.select("sid").distinct(), "ids")  # few, so that no member's tokens move for them
        tokens = scratch.written(members.select("sid", "tokens").join(ids, "sid", "left_semi"), "tokens")
        open_ = scratch.written(_open(rows), "open")
        for r in range(ROUNDS):
            chosen = open_.where((F.col("outside") > BLOCK) & (2 * F.col("outside") > F.col("size")))
            if r < ROUNDS - 1:
                chosen = chosen.where(F.col("tree").isin(2 * r, 2 * r + 1))  # the trees are alike, and a label counts in all of them
            if chosen.isEmpty():
                continue
            cell = F.pmod(F.xxhash64("sid", "tree", F.lit(r)), F.ceil(F.col("size") / BLOCK)).cast("int")
            cells = join_counted(rows, chosen.drop("tree"), "key").select(F.xxhash64("key", F.lit(r), cell).alias("block"), "sid", "label", (F.col("label") == F.col("common")).cast("int").alias("side"))
            found = scratch.written(_links(_candidates(cells, tokens, similarity, scratch), sets, similarity), "links")
            links.append(found)
            least = found.groupBy("a").agg(F.min("b").alias("b"))
            rows = scratch.written(rows.join(least, own == least["a"], "left").select("key", "tree", "sid", F.coalesce("b", "label").alias("label")), "large")
            open_ = scratch.written(_open(rows), "open")
        near = F.lit(True) if depth == DEPTH else F.col("outside") <= COMPARED
        if not open_.where(near).isEmpty():
            blocks.append(_outside_against_all(_as_one(join_counted(rows, open_.where(near).drop("tree"), "key"), scratch)))
        far = open_.where(~near)
        if far.isEmpty():
            break
        nodes = scratch.written(_children(join_counted(rows, far.drop("tree"), "key").join(tokens, "sid").select("key", "tree", "sid", "label", "tokens"), similarity), "nodes")
    every = blocks[0]
    for b in blocks[1:]:
        every = every.unionByName(b)
    out = _links(_candidates(every, members, similarity, scratch), sets, similarity)
    for found in links:
        out = out.unionByName(found)
    return out


def _clusters(linked: np.ndarray) -> np.ndarray:
    """For each member the least member that it is connected to. linked: of the first members (rows) with all (columns)."""
    left, n = linked.shape
    root, before = np.arange(n, dtype=np.int32), None
    while before is None or (root != before).any():
        before = root.copy()
        root[:left] = np.minimum(root[:left], np.where(linked, root[None], n).min(1))
        root = np.minimum(root, np.where(linked, root[:left, None], n).min(0))
        root = root[root]
    return root


def _candidates(blocks: DataFrame, members: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """members, labels, sides: sets of members of a block (block, sid, label, side) that their minwise tokens say may be linked.
    Members of side 1 aren't compared with each other, nor any two of one label."""
    least = least_equal(similarity)

    def near(tokens: np.ndarray, label: np.ndarray, side: np.ndarray) -> np.ndarray:
        n, t = int((side == 0).sum()), np.ascontiguousarray(tokens.T)  # those of side 0 come first
        out = np.zeros((n, len(label)), bool)
        for a in range(0, n, 64):
            u = slice(a, min(a + 64, n))
            equal, one = np.zeros((u.stop - a, len(label) - a), np.uint8), np.empty((u.stop - a, len(label) - a), bool)
            for c in range(COORDINATES):
                np.equal(t[c, u, None], t[c, None, a:], out=one)
                equal += one.view(np.uint8)
            out[u, a:] = (equal >= least) & (label[u, None] != label[None, a:])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, "block"):
            sids, labels, sides, tokens, out = *[t.column(c).to_numpy() for c in ("sid", "label", "side")], _matrix(t.column("tokens"), np.uint8), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a > 1:
                    root = _clusters(near(tokens[a:b], labels[a:b], sides[a:b]))
                    for r in np.flatnonzero(np.bincount(root) > 1):
                        x, k = np.unique(sids[a:b][root == r], return_index=True)  # of a member on both sides that of side 0
                        out.append((x, labels[a:b][root == r][k], sides[a:b][root == r][k]))
            yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in out if len(x[0]) > 1], pa.list_(pa.int64())) for i, c in enumerate(("members", "labels", "sides"))})

    d = blocks.join(members.select("sid", "tokens"), "sid")
    d = d.repartition("block").sortWithinPartitions("block", "side", "sid")
    return scratch.written(d.mapInArrow(run, "members array<long>, labels array<long>, sides array<long>").distinct(), "candidates")


def _links(candidates: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """a, b: of the links of each candidate set, on the full sets, those that connect it: members with the least label
    that they are now connected to, if it isn't theirs."""
    percent = round(100 * similarity)

    def linked(x: list[np.ndarray], left: int) -> np.ndarray:
        n = np.array([len(s) for s in x])
        _, of = np.unique(np.concatenate(x), return_inverse=True)
        row = np.repeat(np.arange(len(x)), n)
        shared = np.bincount(of) > 1
        row, of = row[shared[of]], (np.cumsum(shared) - 1)[of[shared[of]]]
        order = np.argsort(of, kind="stable")
        row, of, both = row[order], of[order], np.zeros((left, len(x)), np.float32)
        width = max(256, 4_000_000 // len(x))
        for c in range(0, int(shared.sum()), width):
            u, v = np.searchsorted(of, [c, c + width])
            has = np.zeros((len(x), width), np.float32)
            has[row[u:v], of[u:v] - c] = 1
            both += has[:left] @ has.T
        return 100 * both >= percent * (n[:left, None] + n[None] - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, "group"):
            labels, sides, raw, left, right = t.column("label").to_numpy(), t.column("side").to_numpy(), t.column("shingles").to_pylist(), [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a > 1:
                    root, own = _clusters(linked([np.frombuffer(x, np.uint64) for x in raw[a:b]], int((sides[a:b] == 0).sum()))), labels[a:b]
                    least = own.copy()
                    np.minimum.at(least, root, own)
                    least = least[root]
                    at_ = np.flatnonzero(least != own)
                    # a label is a member that its bearers are connected to, so both are hung on the least one
                    left += [t.column("sid").to_numpy()[a:b][at_], own[at_]]
                    right += [least[at_], least[at_]]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    d = candidates.select(F.xxhash64("members", "sides").alias("group"), F.explode(F.arrays_zip("members", "labels", "sides")).alias("m"))
    d = d.select("group", F.col("m.members").alias("sid"), F.col("m.labels").alias("label"), F.col("m.sides").alias("side"))
    if (candidates.agg(F.sum(F.size("members"))).first()[0] or 0) <= BROADCAST_ROWS:  # else the sets move to them
        d = F.broadcast(d)
    d = d.join(sets.of(candidates), "sid")
    return d.repartition("group").sortWithinPartitions("group", "side", "sid").mapInArrow(run, "a long, b long").where("a <> b").distinct()


class Sets:
    """The full sets of members, made from their texts when they are first asked for."""

    def __init__(self, docs: DataFrame, members: DataFrame, words: int, scratch: Scratch):
        self.docs, self.members, self.words, self.scratch, self.made = docs, members, words, scratch, []

    def of(self, candidates: DataFrame) -> DataFrame:
        """sid, shingles (binary) of all members of the candidate sets at least."""
        wanted = candidates.select(F.explode("members").alias("sid")).distinct()
        for m in self.made:
            wanted = wanted.join(m.select("sid"), "sid", "left_anti")
        wanted = self.scratch.written(self.members.select("sid", "digest", "least").join(wanted, "sid", "left_semi"), "wanted")
        ids, keyed = wanted.select(F.col("least").alias("_id")).distinct(), wanted.select("sid", "digest")
        if wanted.count() <= BROADCAST_ROWS:  # else the texts move to their ids, and their sets to the members
            ids, keyed = F.broadcast(ids), F.broadcast(keyed)
        texts = corpus(self.docs).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        found = self.scratch.written(_sets(texts, self.words).join(keyed, "digest").select("sid", "shingles"), "sets")
        if not found.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # several rows may have one doc_id
            found = self.scratch.written(found.dropDuplicates(["sid"]), "sets")
        self.made.append(found)
        out = self.made[0]
        for m in self.made[1:]:
            out = out.unionByName(m)
        return out


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """digest, shingles (binary) of the rows that have words, of equal sets of a task one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in slices(batches):
            sets, at = shingle_sets(part.column("text"), words)
            raw, new = sets.tobytes(), {}
            for s in (raw[8 * u : 8 * v] for u, v in zip(at[:-1].tolist(), at[1:].tolist()) if v > u):
                new.setdefault(hashlib.blake2b(s, digest_size=16).digest(), s)
            digest = [d for d in new if d not in seen]
            seen.update(digest)
            x = [new[d] for d in digest]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(x, pa.binary())], ["digest", "shingles"])

    return docs.select("text").mapInArrow(run, "digest binary, shingles binary")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (doc_id = component_id) of every row.

    Words are what ASCII white space parts, A-Z in lower case; a text of fewer words than a shingle is one shingle, and
    one without words (or null) has none and is linked with nothing. Two texts are linked if their distinct shingles'
    intersection is at least `similarity` of their union. Rows with one doc_id are kept or not by it alike. An empty
    table gives no row; null ids are greater than any other; other columns are left out.
    """
    early = Scratch(docs.sparkSession, "signed")
    signed = early.written(signatures(docs, words, trees(similarity)), "signed")
    first = [F.first(c).alias(c) for c in ("roots", "tokens")]
    members = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), *first)
    # the numbers hold from here on, as they are only ever read from the written table
    members = written(members.withColumn("sid", F.monotonically_increasing_id()), "members")
    signed = written(signed.select("doc_id", "n_shingles", "digest"), "digests")
    early.remove()  # the tokens are the members' from here on
    scratch = Scratch(docs.sparkSession, "near")
    try:
        hung = components(_search(members, Sets(docs, members, words, scratch), similarity, scratch))
    finally:
        scratch.remove()
    groups = members.select("digest", "sid", "least", "size").join(hung.withColumnRenamed("a", "sid"), "sid", "left").select("digest", "size", "least", F.coalesce("b", "sid").alias("root"))
    groups = written(groups, "groups")
    roots = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    found = join_counted(groups, roots, "root", "members").select("digest", "size", "component_id")
    have = signed.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest")
    d = join_counted(have, written(found, "found"), "digest").select("doc_id", "n_shingles", "component_id")
    d = d.unionByName(signed.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return d.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def filtered(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs of which one stays for each group, with all their columns; of rows with one doc_id all or none."""
    keep = near_duplicates(docs, words, similarity).where("kept").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
