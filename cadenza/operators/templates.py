"""Templates found in signals by normalised correlation, and what the matches vote for."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.robust import best_hypothesis

#: Numbers in the templates that an executor holds at once, and in the windows of one product.
TEMPLATES, WINDOWS = 4_000_000, 2_000_000
BEST = "array<struct<score:double,label:string,at:int>>"

_held: dict[str, list] = {}


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows less their mean, of length 1; a row without differences is 0."""
    x = x - x.mean(1, keepdims=True)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


def _prepared(templates: list[tuple[str, list[float]]]) -> list[tuple[int, list[str], np.ndarray]]:
    """By length: the labels and the normalised templates."""
    by = defaultdict(list)
    for label, values in templates:
        by[len(values)].append((label, values))
    return [(m, [label for label, _ in own], normalised(np.array([v for _, v in own], float))) for m, own in sorted(by.items())]


def _two_best(signals: np.ndarray, prepared: list) -> list[list[tuple]]:
    """For each of equally long signals the best match (score, label, place) of the two best labels."""
    best: list[dict[str, tuple]] = [{} for _ in signals]
    for m, labels, templates in prepared:
        places = signals.shape[1] - m + 1
        if places < 1:
            continue
        step = max(1, WINDOWS // (places * m))
        for a in range(0, len(signals), step):
            part = signals[a : a + step]
            windows = np.lib.stride_tricks.sliding_window_view(part, m, axis=1).reshape(-1, m)
            scores = (normalised(windows) @ templates.T).reshape(len(part), places, len(labels))
            at = scores.argmax(1)  # of equal scores the first place
            top = np.take_along_axis(scores, at[:, None], 1)[:, 0]
            for i in range(len(part)):
                own = best[a + i]
                for k, label in enumerate(labels):
                    new = (-float(top[i, k]), label, int(at[i, k]))
                    if label not in own or (new[0], new[2]) < (own[label][0], own[label][2]):
                        own[label] = new
    return [[(-s, label, at) for s, label, at in sorted(own.values())[:2]] for own in best]


def matched(df: DataFrame, signal: str, templates: DataFrame, least: float | None = None, held: int = TEMPLATES) -> DataFrame:
    """df with label, score, at (from 0) and margin: the template (label, values) that correlates best with a stretch of the
    signal, and how far the best one of another label is below (null without another). Ties: the first label, then the
    first place. Null where no template fits (longer than the signal), the signal is null or has a null, or, with `least`,
    the score is below. Templates with a null label or value, and empty ones, are left out.

    Templates are shared out by their hash so that an executor holds about `held` numbers; each share is a pass over the
    signals that adds its two best, and the best of all shares is chosen at the end.
    """
    t = templates.where("label IS NOT NULL AND size(values) > 0").where(~F.exists("values", lambda x: x.isNull())).select(F.col("label").cast("string").alias("label"), F.col("values").cast("array<double>").alias("values"))
    numbers = t.agg(F.sum(F.size("values"))).first()[0] or 0
    shares = max(1, -(-numbers // held))
    share = F.pmod(F.xxhash64("label", "values"), F.lit(shares))
    out = df
    for s in range(shares):
        out = out.withColumn(f"_best{s}", _share(df, [tuple(r) for r in t.where(share == s).collect()])(F.col(signal)))
    # the best of each label, then the best two labels
    every = F.array_sort(F.transform(F.concat(*[F.coalesce(f"_best{s}", F.array().cast(BEST)) for s in range(shares)]), lambda x: F.struct((-x["score"]).alias("less"), x["label"].alias("label"), x["at"].alias("at"))))
    out = out.withColumn("_all", every).withColumn("_first", F.get("_all", F.lit(0)))
    second = F.get(F.filter("_all", lambda x: x["label"] != F.col("_first.label")), F.lit(0))
    score = -F.col("_first.less")
    ok = score.isNotNull() if least is None else score >= least
    out = out.select(*df.columns, F.when(ok, F.col("_first.label")).alias("label"), F.when(ok, score).alias("score"), F.when(ok, F.col("_first.at")).alias("at"), F.when(ok, second["less"] - F.col("_first.less")).alias("margin"))
    return out


def _share(df: DataFrame, templates: list[tuple]):
    shared, token = df.sparkSession.sparkContext.broadcast(templates), uuid.uuid4().hex

    @F.arrow_udf(BEST)
    def best(signals: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if token not in _held:
            if len(_held) > 8:
                _held.clear()
            _held[token] = _prepared(shared.value)
        for batch in signals:
            length = pc.list_value_length(batch).to_numpy(zero_copy_only=False)
            rows: list = [None] * len(batch)
            values = batch.to_pylist() if batch.null_count or batch.flatten().null_count else None
            usable = [i for i in range(len(batch)) if length[i] > 0 and (values is None or None not in values[i])]
            for n in sorted({int(length[i]) for i in usable}):
                own = [i for i in usable if length[i] == n]
                x = np.stack([batch[i].values.to_numpy(zero_copy_only=False) for i in own]).astype(float)
                for i, found in zip(own, _two_best(x, _held[token])):
                    rows[i] = [{"score": s, "label": label, "at": at} for s, label, at in found]
            yield pa.array(rows, pa.list_(pa.struct([("score", pa.float64()), ("label", pa.string()), ("at", pa.int32())])))

    return best


def voted(df: DataFrame, keys: list[str], choice: Column, weight: Column) -> DataFrame:
    """keys, choice, votes, margin: the choice with the greatest sum of weights, and its lead (null without another). Rows
    with a null choice or weight don't vote; ties go to the least choice."""
    d = df.select(*keys, choice.alias("choice"), weight.alias("_w")).where("choice IS NOT NULL AND _w IS NOT NULL")
    return best_hypothesis(d.groupBy(*keys, "choice").agg(F.sum("_w").alias("votes")), keys, "choice", "votes")
