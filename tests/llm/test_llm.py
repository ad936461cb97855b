"""The ten operators and the pipeline on small tables: against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and further columns with clashing names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bpe, chosen_path, components, dac, fingerprints, langid, packing, quality, quotes, tokens, toxicity, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, key string, ids string, _cell int, _row int, n_words int"
BASE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark old wood near the river"


def rows():
    rng = random.Random(5)
    words = ["Alpha", "beta,", "gamma", "delta.", "épsilon", "zeta", "eta", "thêta", "iota", "kappa", "it's", "12", "日本"]
    out = [None, "", " ", "\n", "a", "  two  spaces \n\n and <|endoftext|> or <|startoftext|>", BASE, BASE, BASE + " again", BASE.upper(), BASE + "\n" + BASE, "x" * 5000, " ".join(["long"] * 9000), "“quoted” text\twith\x0btabs\x1c", "\x00nul", "Mixed ÀÉ ΑΣ Σ's a ́b"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(24)]
    return [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", -1, 7, "k", "z", 1, 2, 3) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    data = rows()
    data.append(data[6])  # a repeated row
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def ids_of(library, text, *end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, *end], "<u4")


# ---- tokens (5, 7, 10)


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("encoder", [tokens.ModelEncoder, bpe.Backtracking])
def test_chunks_give_the_library_s_ids(libraries, which, encoder):
    if which and encoder is bpe.Backtracking:
        pytest.skip("the backtracking encoder is for byte-level vocabularies")
    rng = random.Random(2)
    texts = [r[1] or "" for r in rows()] + ["".join(rng.choice("abcd  \n\t.,'s12é日́ \x85\xa0XY") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    ids, at = tokens.ChunkTokenizer((BYTE, WORD)[which], encoder).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(libraries[which], t).tolist(), repr(t)


def test_bpe_round_trip(docs, empty, libraries):
    got = bpe.round_trip_digests(docs, BYTE).collect()
    assert len(got) == docs.count() and bpe.round_trip_digests(empty, BYTE).count() == 0
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        ids = ids_of(libraries[0], text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
    whole = {r.doc_id: r for r in bpe.round_trip(docs, BYTE).collect()}
    assert all(r.decoded == (text[k] or "") for k, r in whole.items())
    assert bpe.decode(BYTE, [220, 50256]) == " <|endoftext|>" and bpe.decode(BYTE, [0x80]) == libraries[0].decode([0x80], skip_special_tokens=False)


def test_directly_addressable_codes(docs, empty, libraries):
    files = dac.write(docs, BYTE, end_id=2, rows=7, file_bytes=600)
    assert files.count() > 5
    start = 0
    got = sorted(dac.read_digests(files).collect())
    want = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for r, (doc_id, text) in zip(got, want, strict=True):
        ids = ids_of(libraries[0], text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert dac.read_digests(dac.write(empty, BYTE, end_id=2)).count() == 0


def test_any_token_is_read_by_itself():
    rng = np.random.RandomState(3)
    ids = np.concatenate([rng.randint(0, 300, 3000), rng.randint(0, 2**20, 3000), [0, 255, 256, 65535, 65536, 2**31]]).astype(np.uint32)
    rng.shuffle(ids)
    codes = dac.Codes(dac.dump(np.array([4, 9]), np.array([0, 17, len(ids)]), ids))
    assert codes.slice(0, len(ids)).tolist() == ids.tolist() and codes.slice(511, 1777).tolist() == ids[511:1777].tolist()
    assert all(codes.token(i) == ids[i] for i in range(0, len(ids), 7))
    assert dac.Codes(dac.dump(np.array([], int), np.array([0]), np.array([], np.uint32))).tokens == 0


def packed_right(got, capacity):
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing(docs, empty, libraries):
    got = packing.pack(docs, WORD, end_id=0, capacity=64).collect()
    n = packed_right(got, 64)
    assert n <= 1.1 * -(-sum(r.length for r in got) // 64) + 1
    text = {r.doc_id: r.text for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, rs in by.items():
        ids = ids_of(libraries[1], text[k], 0)
        pieces = [(i, len(p), zlib.crc32(p.tobytes())) for i in range(0, len(ids), 64) for p in [ids[i : i + 64]]]
        copies = 2 if k == 6 else 1  # the repeated row
        assert sorted((r.start, r.length, r.ids_crc32) for r in rs) == sorted(pieces * copies) and all(r.piece * 64 == r.start for r in rs)
    assert len(by) == len(text) and packing.pack(empty, WORD).count() == 0


def test_dominance_keeps_an_optimal_packing():
    rng = random.Random(4)

    def least(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for _ in range(60):
        items = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        count = dict(collections.Counter(items))
        fixed = packing.reduce(count, 12)
        left = [n for n, c in count.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + least(sorted(left, reverse=True), 12) == least(items, 12), items
        used = collections.Counter()
        for pattern, times in fixed + packing.best_fit(count, 12):
            assert sum(n * k for n, k in pattern) <= 12
            for n, k in pattern:
                used[n] += k * times
        assert used == collections.Counter(items)


# ---- 1, 9


def test_fingerprints_against_edited_texts(docs, empty):
    got = fingerprints.against_edited(docs, rows=4).collect()
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(want)
    for i, (k, t) in enumerate(want):
        nxt, n = want[(i + 1) % len(want)][1], len(t)
        sha = hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()
        assert any(r.n_chars == n and r.edited_sha256 == sha for r in by[k])
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in by[k])
    prints = collections.defaultdict(set)
    for k, t in want:
        prints[t].add(by[k][0].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert fingerprints.against_edited(empty).count() == 0
    one = docs.where("doc_id = 6").limit(1)
    assert fingerprints.against_edited(one).first().near_next == 1.0


def test_fingerprints_are_homomorphic(spark):
    d = spark.createDataFrame([(1, "a b c\nd e\nf"), (2, "f\na b c\nd e"), (3, "a b c\nf"), (4, "d e"), (5, "f\nd e")], "doc_id long, text string")
    p = {r.doc_id: r for r in fingerprints.fingerprints(d).collect()}
    assert p[1].fingerprint == p[2].fingerprint != p[3].fingerprint
    pair = spark.createDataFrame([(p[3].lanes, p[4].lanes, p[1].lanes)], "a array<long>, b array<long>, c array<long>")
    r = pair.select(fingerprints.plus(F.col("a"), F.col("b")).alias("s"), fingerprints.minus(F.col("c"), F.col("b")).alias("m")).first()
    assert r.s == p[1].lanes and r.m == p[3].lanes


def test_near_copies_are_alike_after_insertions_and_deletions(spark):
    rng = random.Random(8)
    w = [f"w{rng.randrange(500)}" for _ in range(300)]
    apart = [f"v{rng.randrange(500)}" for _ in range(300)]
    cut = lambda at: [x for i, x in enumerate(w) if i not in at]
    texts = [w, ["new", *w], w[1:], w[:100] + ["new"] + w[100:250], cut({40, 200}), apart]
    d = fingerprints.fingerprints(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    first = d.where("doc_id = 0").select(F.col("lanes").alias("first"))
    got = {r.doc_id: r.x for r in d.crossJoin(first).select("doc_id", fingerprints.likeness(F.col("first"), F.col("lanes")).alias("x")).collect()}
    assert all(got[i] > 0.8 for i in range(1, 5)) and got[5] < 0.4


def test_quality_measures(docs, empty):
    for r in quality.verdicts(docs, least=5).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r.text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        rep = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(words) < 20 or 100 * len(rep) > 30 * len(words)) and not (r.base_failed and r.kept)
    assert quality.verdicts(empty).count() == 0
    kept = quality.filtered(docs, least=5)
    assert kept.columns == docs.columns


def fences_of(spark, groups, least=100):
    """(source, measure) -> fence above. groups: for each source its values of m_symbols, all other measures being 0."""
    own = [("en", s, m, v, n) for s, values in groups.items() for m in quality.RULES for v, n in (collections.Counter(values) if m == "m_symbols" else {0: len(values)}).items()]
    sketch = spark.createDataFrame(own, "lang string, source string, measure string, v long, n long").select("lang", "source", "measure", quality.bucket(F.col("v")).cast("long").alias("bucket"), "n")
    return {(r.source, r.measure): r.above for r in quality.fences(sketch, least).collect()}


def test_quality_fences_follow_the_sketches(spark):
    groups = {"prose": [0] * 4900 + [200] * 100, "code": [0] * 4500 + [1024] * 500, "small": [0] * 9 + [3000], "junk": [3000] * 200}
    f = fences_of(spark, groups)
    above = {s: f[s, "m_symbols"] for s in groups}
    assert above["prose"] < above["code"], "sources of one language with other values above 0 have other fences"
    assert above["small"] < 1000, "a few documents hardly move a fence"
    assert above["junk"] < 3000, "a source in which junk prevails doesn't set its own fence"
    assert fences_of(spark, groups | {"code": [0] * 4500 + [2048] * 500})["code", "m_symbols"] > above["code"], "only the sketch has changed"
    assert f["prose", "m_dup_lines"] == quality.RULES["m_dup_lines"][2]


def test_quality_verdicts_reject_by_group(spark):
    clean, odd = "plain words of some ordinary prose that says little in {} and then {} ends here with nothing new at all {}", "#a $b %c &d |e <f> #g *h $i %j &k |l <m> #n *o $p %q &r |s <t> {} {} {}"
    data = [(i, (clean if i % 20 else odd).format(i, i * 7, i * 13), "en", "prose") for i in range(400)] + [(1000 + i, odd.format(i, i * 7, i * 13), "en", "code") for i in range(400)]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), least=20).collect()}
    assert not any(got[i] for i in range(0, 400, 20)) and all(got[i] for i in range(400) if i % 20) and all(got[1000 + i] for i in range(400))


def test_sql_gives_the_same_rows(spark):
    from cadenza.llm import queries
    from tests_common import duckdb_of, rows_of

    for name, sql in queries.ORACLES.items():
        assert rows_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001")) == rows_of(duckdb_of("/root/testdata/sf0.001").execute(sql)), name


# ---- 2, 3


def test_quotes(spark):
    m = spark.createDataFrame([
        (1, 0, "user", "Hello there.\nHow are you?\nBye", 1), (1, 1, "assistant", "> How are  YOU?\nFine.\n>> nothing\n", 1), (1, 2, "user", "> > how are you?\n> Fine.\nGreat\n", 1),
        (1, 3, "user", None, 1), (2, 0, "user", "> Fine.\nx", 1), (2, 0, "user", "> Fine.\nx", 1), (None, None, None, "> a", 1)], "conv_id long, turn long, role string, text string, hash int")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(m).collect()}
    assert [(got[1, t].text, got[1, t].n_quoted, got[1, t].n_linked, got[1, t].reply_to) for t in range(4)] == [("Hello there.\nHow are you?\nBye", 0, 0, None), ("Fine.", 2, 1, 0), ("Great", 2, 2, 1), ("", 0, 0, 2)]
    assert quotes.conversations(m).count() == 7 and (got[2, 0].n_quoted, got[2, 0].n_linked) == (1, 0)
    p = {(r.conv_id, r.turn, r.passage): r for r in quotes.passages(m).collect()}
    assert p[1, 2, 1].origin == 0 and p[1, 2, 1].hash == p[1, 1, 1].hash and p[1, 2, 1].whole and p[1, 2, 2].origin == 1
    assert quotes.threads(quotes.conversations(m.limit(0))).count() == 0


def test_quotes_like_brute_force(spark):
    rng = random.Random(2)
    data = []
    for conv in range(12):
        said: list[list[str]] = []
        for turn in range(rng.randint(1, 14)):
            out = []
            for _ in range(rng.randint(0, 2)):
                if said and rng.random() < 0.9:
                    own = [x for x in rng.choice(said) if not x.startswith(">")]
                    a = rng.randrange(len(own) + 1)
                    out += ["> " * rng.randint(1, 2) + x.upper() for x in own[a : a + rng.randint(1, 3)]]
                out += [rng.choice("abcde") + rng.choice(" xy") for _ in range(rng.randint(0, 3))] + rng.choice([[], [""], ["> zz"]])
            said.append(out)
            data.append((conv, turn, "u", "\n".join(out)))
    got = {(r.conv_id, r.turn): r for r in quotes.threads(quotes.conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in range(12):
        msgs, chain = [t.split("\n") for c, _, _, t in data if c == conv], {}
        parsed = []
        for text in msgs:
            rows_ = []
            for raw in text:
                mark = re.match(r"\s*((?:>\s?)+)", raw)
                line = " ".join((raw[mark.end() :] if mark else raw).split()).lower()
                if line:
                    rows_.append((mark.group(1).count(">") if mark else 0, line))
            parsed.append(rows_)
        for turn, rows_ in enumerate(parsed):
            own = [[x for k, x in p if k == 0] for p in parsed[:turn]]
            quotes_ = [(k, list(g)) for k, g in ((k, [x for _, x in g]) for k, g in __import__("itertools").groupby((r for r in rows_ if r[0]), key=lambda r: r[0]))]
            votes, linked = collections.defaultdict(lambda: [9, 0]), 0
            for k, p in quotes_:
                origin = max((t for t, o in enumerate(own) if any(o[i : i + len(p)] == p for i in range(len(o)))), default=None)
                if origin is None:
                    each = [max((t for t, o in enumerate(own) if x in o), default=None) for x in p]
                    n = collections.Counter(t for t in each if t is not None)
                    origin, linked = max(n, key=lambda t: (n[t], t), default=None), linked + sum(n.values())
                else:
                    linked += len(p)
                if origin is not None:
                    votes[origin] = [min(votes[origin][0], k), votes[origin][1] + len(p)]
            reply = max(votes, key=lambda t: (-votes[t][0], votes[t][1], t)) if votes else turn - 1 if turn else None
            chain[turn] = (chain[reply][0], chain[reply][1] + 1) if reply is not None else (turn, 0)
            r = got[conv, turn]
            assert (r.n_quoted, r.n_linked, r.reply_to, r.thread, r.depth) == (sum(len(p) for _, p in quotes_), linked, reply, *chain[turn]), (conv, turn)


def test_quotes_take_the_latest_earlier_message(spark):
    m = spark.createDataFrame([(1, t, "u", "same line" if t < 600 else "> same line") for t in range(0, 1200, 3)], "conv_id long, turn long, role string, text string")
    assert {r.reply_to for r in quotes.conversations(m).where("turn >= 600").collect()} == {597}


def test_warc(spark):
    data = [(i, f"http://e.org/{i} é", ["<p>x</p>", "", None, "<b>ü</b>" * 50][i % 4] if i < 8 else f"<i>{i}</i>" * (i * 300), 1) for i in range(16)] + [(3, "http://e.org/3 é", "<b>ü</b>" * 50, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, offset int").repartition(3)
    index = warc.write(pages, file_bytes=3000)
    got = warc.read(index).collect()
    keep = {}
    for i, _, h, _ in data:
        keep[h or ""] = max(keep.get(h or "", -1), i)
    assert len(got) == len(data)
    for r in got:
        raw = (next(h for i, _, h, _ in data if i == r.page_id) or "").encode()
        k = keep[raw.decode()]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to, r.payload) == (("response", None, raw) if k == r.page_id else ("revisit", k, None))
    some = warc.read(index.where("page_id in (9, 12)")).collect()
    assert sorted(r.page_id for r in some) == [9, 12]
    assert warc.ranges(index, gap=0, most=1 << 40).count() == index.select("file").distinct().count()
    assert warc.read(warc.write(pages.limit(0))).count() == 0


# ---- 4


def brute(texts, words):
    sets, root = {}, {}
    for k, t in texts:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
        root[k] = k

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in ks}


def test_near_duplicates(docs, empty):
    got = chosen_path.near_duplicates(docs, words=4)
    want = brute({(r.doc_id, r.text) for r in docs.collect()}, 4)
    rows_ = got.collect()
    assert len(rows_) == docs.count() and {r.doc_id: (r.n_shingles, r.component_id) for r in rows_} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows_)
    assert chosen_path.near_duplicates(empty).count() == 0
    assert chosen_path.filtered(docs).columns == docs.columns


def changed(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.random()}"
    return " ".join(w)


def components_of_changed(texts, base, words):
    """The exact components of texts that differ from base in some places, by a word of their own each: two of them share
    the windows that neither has changed."""
    same = np.array([[x == y for x, y in zip(t.split(), base)] for _, t in texts])
    windows = np.stack([same[:, i : i + words].all(1) for i in range(len(base) - words + 1)], 1).astype(np.float32)
    n, label, before = windows.shape[1], np.arange(len(texts)), None
    while before is None or (label != before).any():
        before = label.copy()
        for a in range(0, len(texts), 1000):
            both = windows[a : a + 1000] @ windows.T
            linked = 100 * both >= 80 * (2 * n - both)
            label[a : a + 1000] = np.minimum(label[a : a + 1000], np.where(linked, label[None], len(texts)).min(1))
        label = label[label]
    return {k: texts[c][0] for (k, _), c in zip(texts, label.tolist())}


@pytest.mark.parametrize("compared", [1 << 40, 64, 0])
def test_near_duplicates_in_large_nodes(spark, monkeypatch, compared):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = [(i, changed(rng, base, rng.choice([1, 2, 3, 4, 6, 9, 12]))) for i in range(160)] + [(500 + i, " ".join(f"y{rng.random()}" for _ in range(50))) for i in range(50)]
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    monkeypatch.setattr(chosen_path, "COMPARED", compared)
    monkeypatch.setattr(chosen_path, "DEPTH", 2)
    got = chosen_path.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(texts, 4)


def test_a_large_group_of_near_copies_grows_in_proportion(spark, monkeypatch):
    """10,000 near copies of one text, some with too many changes to be linked to most, and texts of other kinds."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [(i, changed(rng, base, rng.choice([1, 1, 2, 2, 2, 3, 4, 4, 5, 7]))) for i in range(10_000)] + [(50_000 + i, " ".join(f"y{rng.randrange(3000)}" for _ in range(60))) for i in range(2000)]
    seen, blocks = {}, chosen_path._candidates
    monkeypatch.setattr(chosen_path, "_candidates", lambda b, *rest: [seen.setdefault(len(seen), b.count()), blocks(b, *rest)][1])
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8), words=4).collect()}
    want = components_of_changed(texts[:10_000], base, 4) | {k: k for k, _ in texts[10_000:]}
    assert got == want and len({want[i] for i in range(10_000)}) > 1
    assert sum(seen.values()) < 12_000 * chosen_path.TREES * 2 * chosen_path.COMPARED / chosen_path.WIDE


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_recall_where_nodes_branch(spark, monkeypatch, similarity):
    """Pairs just above the similarity, all in large nodes that branch, as every text has the same words at its start."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(40)]
    n, pairs = 400, 60
    texts = [(i, " ".join(common + [f"o{i}_{j}" for j in range(40)])) for i in range(n)]
    for p in range(pairs):
        own = [f"o{p}_{j}" for j in range(40)]
        drop = 8 if similarity == 0.8 else 19
        texts.append((1000 + p, " ".join(common + own[: 40 - drop] + [f"n{p}_{j}" for j in range(drop)])))
    monkeypatch.setattr(chosen_path, "BLOCK", 32)
    monkeypatch.setattr(chosen_path, "COMPARED", 32)
    monkeypatch.setattr(chosen_path, "DEPTH", 4)
    monkeypatch.setattr(chosen_path, "ROUNDS", 1)
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=1, similarity=similarity).collect()}
    assert np.mean([got[1000 + p] == p for p in range(pairs)]) >= 0.9 and sum(got[k] != k for k in got) <= pairs


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (102, 101)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


# ---- 6, 8


def corpus_of(spark, n=400):
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["sch", "ung", "ein", "der", "ü"], "fr": ["eau", "oi", "ê", "les", "que"]}
    insults = ["worthless", "pathetic", "idiot", "scumbag"]
    data, labels = [], []
    for i in range(n):
        lang = rng.choice(list(parts))
        w = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        data.append((i, " ".join(w), lang, "s", 0, 1, "k", "i", 1, 2, 3))
        labels.append((i, 1, toxic))
    data += [(n, None, "en", "s", 0, 1, "k", "i", 1, 2, 3), (n + 1, "", None, "s", 0, 1, "k", "i", 1, 2, 3), (n + 2, "123 456", "en", "s", 0, 1, "k", "i", 1, 2, 3), (n + 2, "123 456", "en", "s", 0, 1, "k", "i", 1, 2, 3)]
    labels += [(n, 1, None), (n + 1, None, 0), (None, 1, 1), (5, 1, labels[5][2])]
    return spark.createDataFrame(data, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_language(spark, empty):
    d, _ = corpus_of(spark)
    got = langid.identify(d).collect()
    truth = {r.doc_id: r.lang for r in d.collect()}
    known = [r for r in got if r.doc_id < 400 and r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in known]) > 0.95
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id >= 400) and len(got) == d.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert langid.identify(empty).count() == 0


def test_language_does_not_depend_on_partitions(spark):
    d, _ = corpus_of(spark, 100)
    (x, a), (y, b) = langid.sample(d.repartition(1)), langid.sample(d.repartition(7))
    assert a == b and (x == y).all()


def test_the_network_s_tables_give_its_filters():
    net, rng = langid.Network(["a", "b"]), np.random.RandomState(1)
    x = rng.randint(0, langid.SYMBOLS, (5, langid.WINDOW)).astype(np.uint8)
    n = langid.WINDOW - langid.LAST + 1
    want = np.stack([np.max([sum(net.filters[o][row[i + o]] for o in range(langid.LAST)) for i in range(n)], 0) for row in x])
    assert np.allclose(net.pooled(x), np.maximum(want + net.bias, 0), atol=1e-4)


def test_toxicity(spark, empty):
    d, labels = corpus_of(spark)
    model = toxicity.fit(d, labels)
    got = toxicity.score(d, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id < 400").collect()}
    held = [r for r in got if r.doc_id < 400 and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95 and len(got) == d.count()
    new = spark.createDataFrame([(1, "you are a wortless idi0t and pathetik"), (2, "they said “worthless idiot” to me, which is a long way from what others said"), (3, "you are a worthless idiot and pathetic")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    assert s[1] > 0.5 and s[3] > 0.5 and s[2] < s[3]
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    clean = toxicity.filtered(d, labels)
    assert clean.columns == d.columns and clean.count() < d.count()


def test_automata_find_what_edit_distance_finds():
    rng = random.Random(6)
    terms = ["worthless", "idiot", "scum", "pathetic", "moron", "mororo"]
    m = toxicity.Matcher(toxicity.Lexicon({t: 1.0 for t in terms}, {}, set()))

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    words = ["", "a", *terms]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", rng.choice("orsid")])
        words.append("".join(w))
    for w, got in zip(words, m.nearest(words)[0].tolist()):
        want = min((distance(w, t) for t in terms if distance(w, t) <= toxicity.edits(t)), default=None)
        assert (got - 1) % 4 == want if got else want is None, w


def test_stems_are_found_by_the_automaton():
    m = toxicity.Matcher(toxicity.Lexicon({"scumbag": 3.0, "abcde": 1.0}, {"scum": 2.0, "wret": 4.0, "abcd": 5.0}, set()))
    weight, how = m.weigh(["scum", "scummy", "scumbag", "scumbeg", "wretched", "wrxtched", "wret", "abcdx", "clean", ""])
    assert weight.tolist() == [0.0, 2.0, 3.0, 2.0, 4.0, 0.0, 0.0, 5.0, 0.0, 0.0] and how.tolist() == [0, 2, 0, 2, 2, 0, 0, 2, 0, 0]


def test_a_match_counts_less_on_a_quoted_line():
    m = toxicity.Matcher(toxicity.Lexicon({"idiot": 2.0}, {}, set()))
    texts = ["you idiot", "> you idiot", "a\n > you idiot\nb", "> a\nyou idiot", "a > b, you idiot", "he said “you idiot” to me", "> " + "x " * 400 + "idiot", None or "", "\n\n"]
    x = toxicity.features(pa.array(texts), m)
    assert (x[:, 0] / 2).round(6).tolist() == [1, 0.3, 0.3, 1, 1, 0.3, 0.3, 0, 0]


# ---- nulls in every column


def test_null_ids(spark):
    data = [(None, BASE), (None, None), (3, BASE), (4, "a b c"), (2**62 + 1, "d e f " * 30), (None, "z")]
    d = spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None, None) for i, t in data], SCHEMA)
    n = len(data)
    assert fingerprints.against_edited(d, rows=2).count() == n and bpe.round_trip_digests(d, BYTE).count() == n
    got = dac.read_digests(dac.write(d, BYTE, end_id=2, rows=2)).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, -1, -1, 3, 4, 2**62 + 1] and min(r.start for r in got) == 0
    near = chosen_path.near_duplicates(d).collect()
    assert len(near) == n and {r.component_id for r in near if r.n_shingles == 18} <= {3, None}
    assert len({(r.doc_id, r.piece) for r in packing.pack(d, WORD).collect()}) == 4
    assert langid.identify(d).count() == n and quality.verdicts(d).count() == n and quality.filtered(d).count() <= n
    labels = spark.createDataFrame([(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, toxicity.fit(d, labels)).count() == n and toxicity.filtered(d, labels).columns == d.columns
    pages = spark.createDataFrame([(None, None, None), (None, "u", "x"), (4, None, "x")], "page_id long, url string, html string")
    found = warc.read(warc.write(pages)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in found) == [(-1, "response", None), (-1, "revisit", 4), (4, "response", None)]


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d, labels = corpus_of(spark, 200)
    d = d.select("doc_id", "text", "lang", "source", "n_chars")
    copies = d.where("doc_id < 20 AND length(text) > 150").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars")
    d.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(kept.count())
    assert counts[0] > counts[1] > 0 and kept.where("doc_id >= 1000").count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed_right(got, 2048)
    assert {r.doc_id for r in got} == {r.doc_id for r in kept.collect()}
