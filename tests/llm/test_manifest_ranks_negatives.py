"""Merkle manifest, BPE by ranks and hard negatives against brute force, with the odd rows that tables may have."""

import base64
import hashlib
import random
import zlib

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cadenza.llm import merkle, negatives, queries, rank_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, digest string, path string, block int, cell int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- Merkle manifest (11)


def leaf(r, more=0):
    doc_id, text, lang, source, n_chars = r[:5]
    said = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said))


def tree(leaves, arity):
    """The root, and each leaf's siblings before and after it, from the leaf up."""
    paths, held, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        runs = [range(i, min(i + arity, len(nodes))) for i in range(0, len(nodes), arity)]
        for run in runs:
            for k in run:
                for i in held[k]:
                    paths[i].append(("".join(nodes[x] for x in run if x < k), "".join(nodes[x] for x in run if x > k)))
        held = [[i for k in run for i in held[k]] for run in runs]
        nodes = [sha("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def audited(rows, arity):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    trees = [tree([leaf(r) for r in g], arity) for g in groups]
    root, above = tree([t[0] for t in trees], arity)
    out = []
    for g, (subroot, paths), up in zip(groups, trees, above):
        for r, path in zip(g, paths):
            path = path + up
            at = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for before, after in path:
                at = sha(before + at + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in path)), at, at == root))
    return sorted(map(repr, out))


def documents(n):
    rng = random.Random(n)
    texts = [None, "", "a", "ünï", "\x00", "long " * 30_000, "same", "same"]
    rows = [(i * 3 - 20, texts[i % len(texts)] if i < 30 else f"t{i}", rng.choice([None, "", "en", "en", "en", "é", "z", "zz"]), None if i % 5 == 0 else "s", None if i % 6 == 0 else i, "t", 1, "d", "p", 2, 3) for i in range(n)]
    return rows + rows[:2] + [(None, "x", "en", None, 1, *rows[0][5:])] if rows else rows


@pytest.mark.parametrize("n, arity, depth", [(70, 2, 2), (70, 3, 1), (9, 2, 10), (1, 2, 10)])
def test_manifest_equals_plain_trees(spark, n, arity, depth):
    rows = documents(n)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = merkle.audit(docs, merkle.every_seventh(), arity=arity, depth=depth, rows=10).collect()
    assert sorted(repr(tuple(r)) for r in got) == audited(rows, arity)
    if n == 70:
        assert {r.verified for r in got} == {True, False}


def test_manifest_of_no_rows_and_of_one(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS), merkle.every_seventh()).count() == 0
    rows = documents(1)[:1]
    (got,) = merkle.audit(spark.createDataFrame(rows, DOCS), F.lit(False)).collect()
    assert got.leaf == got.subroot == got.root == got.folded_root == leaf(rows[0]) and got.proof_sha256 == sha("") and got.verified


# ---- BPE by ranks (12)


def tiktoken_of():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "\n\n \t x", "a", "<|endoftext|> is text", "\x00nul\x00", "x" * 40_000, "日本語" * 3000, "é‍👩‍👩‍👧 ok", "it's we'll  I'D"]
    out += ["".join(rng.choice("etaoinshrdlu") for _ in range(20_000))]
    return out + ["".join(rng.choice("abthein  \n\t.,'s12é日́ \x85\xa0XY<|>") for _ in range(rng.randint(0, 50))) for _ in range(400)]


def test_ranks_give_the_library_s_ids(spark):
    library, all_texts = tiktoken_of(), texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "t", 1, "ids", "p", 2, 3) for i, t in enumerate(all_texts + all_texts[:3])], DOCS.replace("digest", "ids")).repartition(3)
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(all_texts + all_texts[:3])}
    ids = rank_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    decoded = {r.doc_id: bytes(r.decoded) for r in rank_bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    got = rank_bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(want)
    for r in got:
        raw = ((all_texts + all_texts[:3])[r.doc_id] or "").encode()
        assert decoded[r.doc_id] == raw and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), sha(" ".join(map(str, want[r.doc_id]))))
    for f in (rank_bpe.encode, rank_bpe.round_trip_digests):
        assert f(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in rank_bpe.decode(nothing, RANKS, public_tokenizers.PATTERN).collect()] == [b"", b""]


def test_the_leftmost_least_pair_is_merged_first():
    """Any ranks, also such as no training gives, against a scan of all pairs before every merge."""
    rng = random.Random(4)
    for _ in range(60):
        tokens = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 5))) for _ in range(12)})
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate([b"a", b"b", *tokens])}
        merge = rank_bpe.SegmentTree(ranks).merge
        for _ in range(20):
            raw = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40)))
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while True:
                least = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
                if least is None:
                    break
                parts[least[1] : least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]
            assert merge(raw) == [ranks[p] for p in parts]


# ---- hard negatives (13)


def mined(rows, anchors, positives=5, negatives_=5, low=80, high=100):
    """The same by a loop over all pairs."""
    import math

    kept = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in sorted({(i, label, tuple(v)) for i, label, v in kept if i in anchors}):
        stored = lambda x: (x[1], b"".join(c.to_bytes(4, "little", signed=True) for c in x[2]))
        if stored((i, label, v)) != min(stored(x) for x in kept if x[0] == i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, other) for k, other, w in kept if k != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            found = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            out += [(i, p, rank, k, -s, -t) for rank, (t, k, _) in enumerate(found, 1)]
    return sorted(out)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, score long, low long, anchor_id long, v binary"


def vectors(n, dims, seed):
    rng = random.Random(seed)
    rows = [[i, [rng.gauss(0, 0.3) for _ in range(dims)], rng.randint(0, 3)] for i in range(n)]
    for r in rows[1 : n : 9]:
        r[1] = rows[0][1]  # copies: ties
    return rows


@pytest.mark.parametrize("n, dims", [(300, 64), (120, 5), (2, 3)])
def test_negatives_equal_all_pairs(spark, monkeypatch, n, dims):
    monkeypatch.setattr(negatives, "SAMPLE", 60)
    rows = vectors(n, dims, n)
    odd = [[None, [1.0] * dims, 1], [5000, None, 1], [5001, [1.0] * dims, None], [5002, [None] + [1.0] * (dims - 1), 1], [5003, [float("nan")] * dims, 1], [5004, [float("inf")] * dims, 1], [5005, [], 1], [5006, [1.0], 2], [10, [0.5] * dims, 0]]
    rows = [[i, None if v is None else [None if x is None else float(pa.scalar(x, pa.float32()).as_py()) for x in v], label] for i, v, label in rows + odd + rows[-1:]]
    df = spark.createDataFrame([(*r, 1, 2, 3, b"") for r in rows], EMBEDDINGS).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, set(range(0, 6000, 10)))
    narrow = negatives.mine(df, F.col("vec_id") % 10 == 0, positives=2, negatives=1, low=-50, high=90)
    assert sorted(map(tuple, narrow.collect())) == mined(rows, set(range(0, 6000, 10)), 2, 1, -50, 90)


def test_negatives_of_nothing_and_of_large_components(spark):
    assert negatives.mine(spark.createDataFrame([], EMBEDDINGS), F.col("vec_id") % 10 == 0).count() == 0
    rows = [[0, [260_000.0, 1.0], 0], [1, [250_000.0, 0.0], 0], [2, [240_000.0, 3.0], 1], [3, [1e9, 0.0], 0]]
    got = negatives.mine(spark.createDataFrame([(*r, 1, 2, 3, b"") for r in rows], EMBEDDINGS), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows[:3], {0})  # the last can't be scored in a long


def test_bounds_hold_every_score():
    import numpy as np

    rng = np.random.RandomState(1)
    v = np.floor(256 * rng.randn(200, 64) * rng.choice([0.01, 1, 30], (200, 1)))
    means, deviations = negatives.summaries(v)
    exact, at = v @ v.T, 0
    for s in negatives.SEGMENTS:
        m, d = means[:, at : at + s], deviations[:, at : at + s]
        assert (np.abs(exact - m @ m.T) <= d @ d.T * (1 + 1e-9) + 1e-3).all()
        at += s


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, name):
    """Every query over its whole table: a row for each of the table's, but for pieces and negatives."""
    folder = "/root/testdata/sf0.001"
    n = queries.QUERIES[name](spark, folder).count()
    rows = spark.read.parquet(f"{folder}/{ {'op3_warc': 'pages', 'op2_quotes': 'conversations', 'op13_hard_negatives': 'embeddings'}.get(name, 'documents') }.parquet").count()
    assert n >= rows if name == "op7_packing" else 0 < n if name == "op13_hard_negatives" else n == rows
