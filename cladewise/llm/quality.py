"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: of bytes (3 and 4, case kept) and of word shapes (1 to 3). Each is
scaled by its class log-count ratio, counted over every labelled row; a linear hinge-loss model is
then fitted by dual coordinate descent on a bounded sample of labelled rows, and a fifth of that
sample sets the two numbers that turn a margin into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import guarded, map_arrow, share_of, text_or_empty
from .wordhash import BLANK_WORDS, mix, text_chunks, word_hashes, word_spans

#: Buckets of hashed features; bound on the distinct labelled texts that the hinge loss is fitted on; share of it that a rare class may fill.
BUCKETS, FIT_ROWS, RARE = 1 << 18, 4000, 0.1
#: Smoothing of counts, penalty, passes, share of the fitted weights against their mean size.
ALPHA, PENALTY, EPOCHS, BETA = 1.0, 1.0, 12, 0.5

_M3, _M4 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _shapes() -> np.ndarray:
    """Class of a byte: lower 1, upper 2, digit 4, sentence mark 8, other sign 16, beyond ASCII 1."""
    out = np.full(256, 16, dtype=np.uint64)
    out[97:123], out[128:], out[65:91], out[48:58] = 1, 1, 2, 4
    out[[ord(c) for c in ".,;:?'\"-()"]] = 8
    return out


SHAPES = _shapes()


def features(texts: pa.Array):
    """For each text its distinct feature numbers; an empty text has none."""
    for _, data, offsets in text_chunks(texts):
        low, starts, ends, bounds = word_spans(data, offsets, BLANK_WORDS)
        words = word_hashes(low, starts, ends)
        raw = data.astype(np.uint64)
        kinds = np.bitwise_or.reduceat(SHAPES[data], starts) if len(starts) else np.zeros(0, dtype=np.uint64)
        if len(starts):
            kinds = kinds | (SHAPES[data[starts]] << np.uint64(5)) | (SHAPES[data[ends - 1]] << np.uint64(10)) | (np.minimum((ends - starts) // 6, 3).astype(np.uint64) << np.uint64(15))
            for back in (1, 2, 3):
                same = np.zeros(len(words), dtype=bool)
                same[back:] = words[back:] == words[:-back]
                kinds[same] |= np.uint64(1 << 20)
        three = mix(raw[:-2] | (raw[1:-1] << np.uint64(8)) | (raw[2:] << np.uint64(16)) | _M3) if len(raw) > 2 else raw[:0]
        four = mix((raw[:-3] | (raw[1:-2] << np.uint64(8)) | (raw[2:-1] << np.uint64(16)) | (raw[3:] << np.uint64(24))) * _M4) if len(raw) > 3 else raw[:0]
        one = mix(kinds + np.uint64(1 << 40))
        two = mix(one[:-1] * _M3 + one[1:]) if len(one) > 1 else one[:0]
        thr = mix(two[:-1] * _M4 + one[2:]) if len(one) > 2 else one[:0]
        last = np.uint64(BUCKETS - 1)
        three, four, one, two, thr = ((x & last).astype(np.int64) for x in (three, four, one, two, thr))
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for a, b, i, j in zip(offsets[:-1], offsets[1:], bounds[:-1], bounds[1:], strict=True):
            h = np.concatenate((three[a : max(b - 2, a)], four[a : max(b - 3, a)], one[i:j], two[i : max(j - 1, i)], thr[i : max(j - 2, i)]))
            at = np.arange(len(h))
            seen[h] = at
            yield h[seen[h] == at]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = self.weights[found].sum() / np.sqrt(max(len(found), 1)) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; rows are scaled indicators over the root of their number, and a constant."""
    values = lambda r: ratio[r] / np.sqrt(max(len(r), 1))  # noqa: E731  made anew each time: the sample is held once
    square = np.array([values(r) @ values(r) + 1.0 for r in rows])
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    share = np.where(y > 0, penalty * len(y) / max(2 * (y > 0).sum(), 1), penalty * len(y) / max(2 * (y < 0).sum(), 1))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            value = values(rows[i])
            slack = y[i] * (w[rows[i]] @ value + bias) - 1.0
            new = min(max(dual[i] - slack / square[i], 0.0), share[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[rows[i]] += step * value
                bias += step
                moved, dual[i] = max(moved, abs(new - dual[i])), new
        if moved < 1e-3:
            break
    mean = np.abs(w).mean()
    return ((1 - BETA) * mean + BETA * w) * ratio, bias


def calibrate(margins: np.ndarray, good: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins (Newton's method on smoothed targets), rows weighted."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g = np.array([(weight * (p - target) * margins).sum() + 1e-3 * a, (weight * (p - target)).sum()])
        v = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on rows (text, quality 0/1); rows with another or no label are left out.

    Counts cover every row and meet as one row of each feature. The fitted sample is about ``fit_rows`` distinct texts, those with a
    small hash of their text (all where there are fewer); its feature numbers come to the driver. A class with less than
    ``RARE`` of the texts fills that share as far as it can, and the calibration weighs its texts down to their part.
    """
    rows = labelled.where(F.col("quality").isin(0, 1)).select(text_or_empty().alias("text"), F.col("quality").cast("int").alias("quality"))

    def count(batches):
        held = np.zeros((2, BUCKETS), dtype=np.int64)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for label, found in zip(labels, features(batch.column(0)), strict=True):
                held[label, found] += 1
                n[label] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[0, at], n[0])), pa.array(np.append(held[1, at], n[1]))], names=["f", "n0", "n1"])

    def number(batches):
        for batch in batches:
            found = [x.astype(np.int32) for x in features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["found", "quality", "place"])

    sums = map_arrow(rows, count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    at, counts = sums["f"].to_numpy(), np.zeros((2, BUCKETS + 1))  # place -1 holds the rows
    counts[0, at], counts[1, at] = sums["n0"].to_numpy(), sums["n1"].to_numpy()
    n0, n1 = counts[:, -1].tolist()
    counts = counts[:, :-1]
    if not n0 or not n1:  # one class or none: a constant
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log((n1 + 1) / (n0 + 1))))
    ratio = np.log((counts[1] + ALPHA) / (n1 + 2 * ALPHA)) - np.log((counts[0] + ALPHA) / (n0 + 2 * ALPHA))
    # Copies count in the classes' features, but the bound is one of distinct texts.
    texts = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    part = {c: fit_rows * n / sum(texts.values()) for c, n in texts.items()}
    quota = {c: max(x, fit_rows * RARE) for c, x in part.items()}
    bound = F.when(F.col("quality") == 1, F.lit(quota[1] / texts[1])).otherwise(F.lit(quota[0] / texts[0]))
    picked = rows.where(share_of(F.col("text")) < bound).dropDuplicates(["text", "quality"]).withColumn("place", F.xxhash64("text", "quality"))
    sample = map_arrow(picked, number, "found array<int>, quality int, place long").toArrow().sort_by("place")
    lists = sample["found"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    found = [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    y = np.where(sample["quality"].to_numpy() == 1, 1.0, -1.0)
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back[:] = False
    if not len(y):
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log((n1 + 1) / (n0 + 1))))
    w, bias = descend([f for f, b in zip(found, back, strict=True) if not b], y[~back], ratio)
    use = back if back.any() else ~back
    margins = np.array([w[f].sum() / np.sqrt(max(len(f), 1)) + bias for f, u in zip(found, use, strict=True) if u])
    weight = {c: min(part[c] / texts[c], 1.0) / min(quota[c] / texts[c], 1.0) for c in texts}
    return Model(w.astype(np.float32), bias, *calibrate(margins, y[use] > 0, np.where(y[use] > 0, weight[1], weight[0])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text and the other columns of ``docs`` with quality_score (0 to 1), for every row.

    Null and empty texts have no feature and get the score of the constant alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("quality_score")
    names = docs.columns

    def run(batches):
        for batch in batches:
            text = batch.column(names.index("text"))
            scores = [shared.value.score(x) for x in features(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "quality_score"])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Model from the documents that ``labels`` marks; of several marks of one id the smallest counts."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return fit(docs.select("doc_id", "text").join(guarded(marks), "doc_id"), fit_rows)


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``; ``labels`` (doc_id, quality) holds the rows to learn from.

    Repeated rows each give their row, null ids are scored and never learned from, other columns
    are ignored; without labels of both classes the score is the share of the label that there is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = score(rows, learn(docs, labels, fit_rows))
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
