"""Language of whole texts by a small convolutional network over bytes, trained and run in numpy.

Bytes fall into 64 symbols: letters without case, white space, digits, other ASCII, and the bytes above 127. A text is
cut into windows of WINDOW bytes, the last one padded. Filters of two to five symbols slide over a window, the largest
response of each filter in the window is kept, and a softmax over these gives the window's probabilities. A text's
probabilities are the mean of its windows', weighted by their letters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import corpus, held_out, slices

WINDOW, SYMBOLS, WIDTHS, FILTERS = 256, 64, (2, 3, 4, 5), 12
LAST = max(WIDTHS)
#: Training reads this many documents of each language at most, and this many windows of each.
SAMPLE, WINDOWS_EACH = 800, 4


def symbols() -> np.ndarray:
    """The symbol of each byte; 0 is left to padding."""
    out = np.full(256, 29, np.uint8)
    for i in range(26):
        out[65 + i] = out[97 + i] = 1 + i
    out[48:58] = 27
    out[[9, 10, 11, 12, 13, 32]] = 28
    out[128:] = 30 + np.arange(128) % 34
    return out


BYTE = symbols()


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all windows, and the number of windows of each text (one at least)."""
    k = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    out = np.zeros(int(k.sum()) * WINDOW, np.uint8)
    for t, a in zip(texts, ((np.cumsum(k) - k) * WINDOW).tolist()):
        out[a : a + len(t)] = np.frombuffer(t, np.uint8)
    raw = out.astype(bool)
    return np.where(raw, BYTE[out], 0).astype(np.uint8).reshape(-1, WINDOW), k


class Network:
    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.RandomState(seed)
        self.languages = languages
        self.filters = rng.normal(0, 0.3, (LAST, SYMBOLS, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.mask = np.array([[o < w for w in WIDTHS for _ in range(FILTERS)] for o in range(LAST)], np.float32)[:, None, :]
        self.filters *= self.mask
        self.bias = np.zeros(self.filters.shape[2], np.float32)
        self.out = rng.normal(0, 0.1, (self.filters.shape[2], len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses to two symbols at once at offsets 0 and 2, and to one at offset 4."""
        f = self.filters
        pair = lambda o: (f[o][:, None] + f[o + 1][None]).reshape(SYMBOLS * SYMBOLS, -1)
        return pair(0), pair(2), f[4]

    def pooled(self, x: np.ndarray, tables=None) -> np.ndarray:
        """The largest response of each filter in each window."""
        a, b, c = tables or self.tables()
        two = x[:, :-1].astype(np.int32) * SYMBOLS + x[:, 1:]
        n = WINDOW - LAST + 1
        out = np.empty((len(x), a.shape[1]), np.float32)
        for i in range(0, len(x), 64):
            z = a.take(two[i : i + 64, :n], axis=0)
            z += b.take(two[i : i + 64, 2 : 2 + n], axis=0)
            z += c.take(x[i : i + 64, 4 : 4 + n], axis=0)
            out[i : i + 64] = z.max(1)
        return np.maximum(out + self.bias, 0)

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        z = self.pooled(x, tables) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 1) -> None:
        """Adam on the cross-entropy; the gradient of a largest response goes to its place alone."""
        rng, n = np.random.RandomState(seed), WINDOW - LAST + 1
        params = [self.filters, self.bias, self.out, self.out_bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xs, ys = x[order[i : i + batch]], y[order[i : i + batch]]
                z = sum(self.filters[o].take(xs[:, o : o + n], axis=0) for o in range(LAST))
                best = z.argmax(1)
                raw = np.take_along_axis(z, best[:, None], 1)[:, 0] + self.bias
                h = np.maximum(raw, 0)
                q = h @ self.out + self.out_bias
                q = np.exp(q - q.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(ys)), ys] -= 1
                q /= len(ys)
                dh = (q @ self.out.T) * (raw > 0)
                df = np.zeros_like(self.filters)
                cols = np.broadcast_to(np.arange(h.shape[1]), best.shape)
                for o in range(LAST):
                    np.add.at(df[o], (np.take_along_axis(xs, best + o, 1), cols), dh)
                t += 1
                for p, g, m, v in zip(params, [df * self.mask, dh.sum(0), h.T @ q + 1e-4 * self.out, q.sum(0)], first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def sample(docs: DataFrame, per_language: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, list[str]]:
    """Windows at random places of at most about per_language training documents of each language, and their languages.
    Documents are those with a text, a language and crc32(doc_id) mod 5 other than 0."""
    d = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_language / n) * 1e9))]), F.col("lang")) if counts else F.lit(0)
    d = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**9)) < share)
    places = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)), lambda i: F.pmod(F.xxhash64("doc_id", i), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int"))
    d = d.select("doc_id", "lang", F.transform(places, lambda p: F.substring(F.col("text"), p + 1, F.lit(WINDOW))).alias("parts"))
    texts, langs = [], []
    for r in sorted(d.collect(), key=lambda r: (r.doc_id, r.lang, r.parts)):  # of a bounded sample, whatever its partitions
        for i, p in enumerate(dict.fromkeys(r.parts)):
            raw, rng = p.encode()[:WINDOW], np.random.RandomState(zlib.crc32(f"{seed} {r.doc_id} {i}".encode()))
            if rng.rand() < 0.5:  # short texts have to be told apart as well
                a = rng.randint(0, max(1, len(raw) - 8))
                raw = raw[a : a + rng.randint(8, 120)]
            texts.append(raw)
            langs.append(r.lang)
    return (windows(texts)[0] if texts else np.zeros((0, WINDOW), np.uint8)), langs


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Network | None:
    """A network for the languages of the training documents; None if there is none."""
    x, langs = sample(docs, per_language)
    if not len(x):
        return None
    names = sorted(set(langs))
    net = Network(names)
    net.train(x, np.array([names.index(lang) for lang in langs]))
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text. `und` with score 0 if the text is null or
    has no letter (or nothing was learned). Rows are independent; columns other than doc_id and text aren't read."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        tables = net.tables() if net else None
        for part in slices(batches, rows=500):
            known = pc.match_substring_regex(part.column("text"), r"\pL").to_numpy(zero_copy_only=False)
            lang, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
            if net and known.any():
                where = np.flatnonzero(known)
                x, k = windows([t.encode() for t in part.column("text").take(pa.array(where)).to_pylist()])
                letters = ((x > 0) & (x < 27) | (x > 29)).sum(1) + 1e-6
                at = np.cumsum(k) - k
                p = np.add.reduceat(net.probabilities(x, tables) * letters[:, None], at) / np.add.reduceat(letters, at)[:, None]
                for i, b, s in zip(where.tolist(), p.argmax(1).tolist(), p.max(1).tolist()):
                    lang[i], score[i] = net.languages[b], min(1.0, s)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return corpus(docs, held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """predict() by a network learned from the training documents of docs alone: those with a text, a language and an id
    that isn't held out. Null ids, texts and languages are never learned from; repeated rows are predicted each."""
    return predict(docs, fit(docs))
