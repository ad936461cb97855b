"""Toxicity of whole texts: terms of a learned lexicon, misspelled ones too, weighed by their context.

The lexicon holds words and stems that mark toxic training documents. They form a trie, and Levenshtein automata (one
edit for words of five letters or more, two for nine or more, none for stems) run on the trie all at once: the pairs of a
trie node and a number of edits that a prefix of a word can reach are one state of a deterministic automaton, which is
built as words need it and steps many words at a time; a state also keeps which stem the word began with. A match counts
by its term's weight and its context: one between quotation marks, or on a line that begins with `>`, counts less than
one that addresses the reader. A logistic regression over these sums gives the
score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import Scratch, corpus, held_out, slices, written

#: Training reads at most about this many labelled documents of each class, which bounds the lexicon as well; a term or
#: stem comes in at least so many toxic ones that differ in the neighbours it has (copies of one text have the same, so
#: that they count once; of each text that pair of neighbours counts whose hash is the least).
SAMPLE, CONTEXTS, CHANCE = 5000, 3, 100
#: Words around a match that are searched for quotation marks, and what a match between them counts.
CONTEXT, QUOTED = 12, 0.3
OPEN, CLOSE, BOTH = "“«„‹‘", "”»›’", "\""
#: Stands for the end of a line among words.
BREAK = "\x02"
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
WS = r"[\x20\x09-\x0D]+"


def edits(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


@dataclass
class Lexicon:
    """weights: of whole words; stems: of beginnings; benign: words near a term that clean documents have."""

    weights: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    benign: set[str] = field(default_factory=set)


class Matcher:
    """Tells for many words at a time the term that is nearest to each, and at how many edits."""

    STATES = 200_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.terms = sorted(lexicon.weights)
        self.stems = sorted(lexicon.stems, key=lambda s: (-lexicon.stems[s], s))
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.term, self.stem = [0], [-1], [-1]
        for i, t in enumerate(self.terms):
            self.term[self._insert(t, edits(t))] = i
        for i, t in enumerate(self.stems):
            self.stem[self._insert(t, 0)] = i
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for t in (*self.terms, *self.stems) for c in t}))}
        self.letters = ["", *self.alphabet]
        self.code = np.zeros(0x110000, np.uint8 if len(self.letters) < 256 else np.uint16)
        for c, i in self.alphabet.items():
            self.code[ord(c)] = i
        self._reset()

    def _insert(self, t: str, allowed: int) -> int:
        at = 0
        self.allowed[0] = max(self.allowed[0], allowed)
        for c in t:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.allowed.append(0)
                self.term.append(-1)
                self.stem.append(-1)
            at = self.children[at][c]
            self.allowed[at] = max(self.allowed[at], allowed)
        return at

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accept, self.begun = np.zeros(1024, np.int32), np.full(1024, -1, np.int32)
        self.table = np.full((1024, len(self.letters)), -1, np.int32)
        self.dead = self._state(frozenset())
        self.table[self.dead] = self.dead
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With what deletions reach, and of each node the fewest edits alone."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            n, e = todo.pop()
            if n < 0:  # a stem that the word began with
                best[n] = 0
                continue
            if e > self.allowed[n] or best.get(n, 9) <= e:
                continue
            best[n] = e
            todo += [(m, e + 1) for m in self.children[n].values()]
        return frozenset(best.items())

    def _state(self, s: frozenset) -> int:
        i = self.ids.get(s)
        if i is None:
            i = self.ids[s] = len(self.sets)
            self.sets.append(s)
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.accept = np.concatenate([self.accept, np.zeros_like(self.accept)])
                self.begun = np.concatenate([self.begun, np.full_like(self.begun, -1)])
            # term * 4 + edits + 1 of the nearest term, 0 for none
            ends = [(e, self.term[n]) for n, e in s if n >= 0 and self.term[n] >= 0 and e <= edits(self.terms[self.term[n]])]
            self.accept[i] = (lambda e, t: t * 4 + e + 1)(*min(ends)) if ends else 0
            self.begun[i] = min((-1 - n for n, _ in s if n < 0), default=-1)  # the stem of the greatest weight
        return i

    def _step(self, state: int, code: int) -> int:
        c, out = self.letters[code], set()
        for n, e in self.sets[state]:
            if n < 0 or e == 0 and self.stem[n] >= 0:
                out.add((n if n < 0 else -1 - self.stem[n], 0))
            if n < 0:
                continue
            out.add((n, e + 1))  # a letter too many
            out.update((m, e if x == c else e + 1) for x, m in self.children[n].items())
        return self._state(self._closed(out))

    def nearest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word 0, or its nearest term's number * 4 + edits + 1; and the number of a stem that it goes on from, or -1."""
        if len(self.sets) > self.STATES:
            self._reset()
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.code[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        at, state, live, j = np.cumsum(n) - n, np.full(len(words), self.start), np.flatnonzero(n > 0), 0
        while len(live):
            s, c = state[live], codes[at[live] + j]
            to = self.table[s, c]
            if (to < 0).any():
                for a, b in set(zip(s[to < 0].tolist(), c[to < 0].tolist())):
                    t = self._step(a, b)  # may enlarge the table
                    self.table[a, b] = t
                to = self.table[s, c]
            state[live] = to
            j += 1
            live = live[(to != self.dead) & (n[live] > j)]
        return self.accept[state], self.begun[state]

    def weigh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the weight of what it matches (0: nothing), and how: 0 as it is, 1 misspelled, 2 by a stem."""
        bare = [EDGES.sub("", w) if not w.isalpha() else w for w in words]
        (found, begun), weight, how = self.nearest(bare), np.zeros(len(words)), np.zeros(len(words), int)
        for i in np.flatnonzero(found).tolist():
            t, e = divmod(int(found[i]) - 1, 4)
            if not e:
                weight[i] = self.lexicon.weights[self.terms[t]]
            elif bare[i] not in self.lexicon.benign:
                weight[i], how[i] = self.lexicon.weights[self.terms[t]], 1
        for i in np.flatnonzero(begun >= 0).tolist():
            s = self.lexicon.stems[self.stems[begun[i]]]
            if how[i] or s > weight[i]:
                weight[i], how[i] = s, 2
        return weight, how


def quoted(before: list[str], own: str, after: list[str]) -> bool:
    """Whether a match stands between quotation marks, as far as the context shows."""
    left, right = " ".join(before) + " " + own, own + " " + " ".join(after)
    depth = sum(left.count(c) for c in OPEN) - sum(" ".join(before).count(c) for c in CLOSE)
    return depth > 0 and any(c in right for c in CLOSE) or sum(" ".join(before).count(c) for c in BOTH) % 2 == 1 and any(c in right for c in BOTH) or own[:1] in BOTH and own[-1:] in BOTH and len(own) > 1


#: Of exact matches, of misspelled ones and of stems the sum of weights by context; of all: the share of words, distinct ones.
FEATURES = 5


def features(texts: pa.Array, matcher: Matcher) -> np.ndarray:
    lines = pc.replace_substring(pc.utf8_lower(texts.cast(pa.large_string())), "\n", f" {BREAK} ")
    parts = pc.split_pattern(pc.replace_substring_regex(lines, WS, " "), " ")
    at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    weight, how = matcher.weigh(words)
    out = np.zeros((len(texts), FEATURES))
    hits = np.flatnonzero(weight[codes])
    if not len(hits):
        return out
    ends = np.fromiter((w == BREAK for w in words), bool, len(words))[codes]
    doc = np.searchsorted(at, hits, "right") - 1
    n = np.maximum(1, np.diff(at) - np.add.reduceat(np.append(ends, False), np.minimum(at[:-1], len(ends))) * (np.diff(at) > 0))
    seen: list[set[int]] = [set() for _ in range(len(texts))]
    for h, d in zip(hits.tolist(), doc.tolist()):
        a, b = int(at[d]), int(at[d + 1])
        first = h - CONTEXT
        while first > a and not ends[first:h].any():
            first -= 8 * CONTEXT  # to where the line begins
        first = max(a, first)
        begin = first + int(np.flatnonzero(ends[first:h])[-1]) + 1 if ends[first:h].any() else a
        while begin < h and not words[codes[begin]]:
            begin += 1
        near = lambda x, y: [words[c] for c in codes[max(a, x) : min(b, y)]]
        c = int(codes[h])
        s = QUOTED if words[codes[begin]].startswith(">") or quoted(near(h - CONTEXT, h), words[c], near(h + 1, h + 1 + CONTEXT)) else 1.0
        out[d, int(how[c])] += s * weight[c]
        out[d, 3] += s / n[d]
        if c not in seen[d]:
            seen[d].add(c)
            out[d, 4] += s
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, :3]), np.log1p(100 * x[:, 3]), np.log1p(x[:, 4])])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray


def training(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of about `most` labelled training documents of each class at most, chosen by hash. What is
    broadcast is bounded by twice `most`."""
    lab = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, int(min(1.0, most / counts.get(1, 1)) * 1e9)).otherwise(int(min(1.0, most / counts.get(0, 1)) * 1e9))
    ids = lab.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(10**9)) < share)
    return written(corpus(docs).join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxic-sample")


def learn_lexicon(sampled: DataFrame, contexts: int = CONTEXTS) -> Lexicon:
    """Words and stems that toxic training documents have far more often than clean ones, by their log-odds. All that
    reaches the driver are words of a bounded sample."""
    bare = F.transform(F.split(F.lower("text"), WS), lambda w: F.regexp_replace(w, r"^[\W_]+|[\W_]+$", ""))
    d = sampled.select("toxic", "doc_id", F.filter(bare, lambda w: w != "").alias("w")).select("toxic", "doc_id", "w", F.posexplode("w").alias("i", "word"))
    pair = F.when(F.col("toxic") == 1, F.xxhash64(F.coalesce(F.get("w", F.col("i") - 1), F.lit("")), F.coalesce(F.get("w", F.col("i") + 1), F.lit(""))))
    d = d.select("toxic", "doc_id", "word", pair.alias("pair")).where("length(word) BETWEEN 2 AND 40")
    d = d.groupBy("word", "doc_id", "toxic").agg(F.min("pair").alias("pair"))
    per = [F.count_if(F.col("toxic") == k).alias(n) for k, n in ((1, "bad"), (0, "good"))]
    scratch = Scratch(sampled.sparkSession, "lexicon")
    d = scratch.written(d.groupBy("word").agg(*per, F.count_distinct("pair").alias("contexts")), "words")
    bad, good = sampled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not bad or not good:
        scratch.remove()
        return Lexicon()
    words, share = d.agg(F.count("*"), F.sum("bad") / F.sum(F.col("bad") + F.col("good"))).first()
    n, k = F.col("contexts") + F.col("good"), F.col("contexts")
    # a bound on -log of the probability that so many of n texts are toxic by chance; one term in CHANCE lexicons may be
    chance = k * F.log(k / (n * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    marked = lambda t, least: {r.word: float(r.w) for r in t.withColumn("w", odds).where((F.col("contexts") >= contexts) & (chance > math.log(CHANCE * words)) & (F.col("w") > least)).select("word", "w").collect()}
    weights = marked(d, 2.0)
    stems = d.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda k: F.when(F.length("word") > k, F.substring("word", F.lit(1), k)))).alias("word"), "bad", "good", "contexts")
    stems = stems.where("word IS NOT NULL").groupBy("word").agg(F.least(F.sum("bad"), F.lit(bad)).alias("bad"), F.sum("good").alias("good"), F.sum("contexts").alias("contexts"), F.count_if(F.col("contexts") >= contexts).alias("n")).where("n >= 6")
    stems = marked(stems, 1.0)  # of several that a word begins with the one of the greatest weight counts
    sc = sampled.sparkSession.sparkContext.broadcast(Lexicon(weights, {}, set()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(sc.value)
        for b in batches:
            found = m.nearest(b.column("word").to_pylist())[0] if b.num_rows else np.zeros(0, int)
            yield b.filter(pa.array((found > 0) & ((found - 1) % 4 > 0)))

    # words near a term that clean documents have
    benign = {r.word for r in d.where("good > 0 AND bad < 10 * good").select("word").mapInArrow(near, "word string").collect()}
    scratch.remove()
    return Lexicon(weights, stems, benign)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Lexicon and regression from training rows alone (see training()). Toxic rows are also learned with their matches
    misspelled, so that misspelled terms weigh as much."""
    sampled = training(docs, labels, most)
    lexicon = learn_lexicon(sampled)
    rows = _featured(sampled.select("doc_id", "text", "toxic"), lexicon, "toxic").collect()  # FEATURES numbers for each of a bounded sample
    if not rows or len({r.toxic for r in rows}) < 2:
        return Model(lexicon, np.array([-3.0] + [0.0] * FEATURES))
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    swapped = x[y == 1].copy()
    swapped[:, [0, 1]] = swapped[:, [1, 0]]
    x, y = scaled(np.concatenate([x, swapped])), np.concatenate([y, np.ones(len(swapped))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        ridge = np.full(len(w), 1.0)
        ridge[0] = 0.0
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(lexicon, w)


def _featured(docs: DataFrame, lexicon: Lexicon, kept: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for part in slices(batches):
            x = features(part.column("text"), matcher)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(kept), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", kept, "x"])

    kind = dict(docs.dtypes)[kept]
    return docs.select("doc_id", "text", kept).mapInArrow(run, f"doc_id long, {kept} {kind}, x array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every row, from its whole text; null texts are empty.
    Rows are independent, repeated ones are scored each; columns other than doc_id and text aren't read."""
    d = _featured(corpus(docs, held_out().alias("held_out")), model.lexicon, "held_out")
    w, x = model.coefficients.tolist(), lambda i: F.get("x", i)
    z = F.lit(w[0]) + w[1] * F.log1p(x(0)) + w[2] * F.log1p(x(1)) + w[3] * F.log1p(x(2)) + w[4] * F.log1p(100 * x(3)) + w[5] * F.log1p(x(4))
    s = 1 / (1 + F.exp(-z))
    return d.select("doc_id", "held_out", s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns; rows with one doc_id go if one of them is."""
    toxic = score(docs, fit(docs, labels)).where("predicted = 1").select("doc_id").distinct()
    return docs.join(toxic, docs["doc_id"].eqNullSafe(toxic["doc_id"]), "left_anti")
