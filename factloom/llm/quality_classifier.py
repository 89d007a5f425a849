"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words, pairs of words, byte trigrams, and up to three shapes of words
in a row (case, length, first and last character, whether the word repeats the one before), with one for the
text's length. Each indicator is scaled by its log-count ratio between the classes, rows are scaled to unit length,
and a linear hinge-loss model is fitted by dual coordinate descent. Platt's sigmoid, fitted on rows kept from the
fit, turns margins into scores.

The fit reads at most SAMPLE labelled rows, those of the smallest id hashes, none of them held out; counts of
n-grams and the model come from these rows. Every document is scored, whole, with the broadcast weights (BITS fixes
their size).

Defined cases: null and empty texts are scored by the length indicator alone; labels that are null or of held-out
ids are left out and of contradicting labels the larger counts; of several texts of a labelled id the least is used; without labels of both classes all scores are 0.5;
a null doc_id is scored and not held out; repeated rows get the same score; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SEGMENT, SPACE, _segment_words, bounded, mix, text_buffers

SAMPLE, BITS, COST, EPOCHS, SMOOTHING, CALIBRATION = 5000, 18, 1.0, 10, 1.0, 0.25


# ---------------------------------------------------------------- features


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A code for the looks of each word."""
    kind = np.full(256, 5, np.int64)
    kind[128:] = 0
    kind[[*range(97, 123)]] = 0
    kind[[*range(65, 91)]] = 1
    kind[[*range(48, 58)]] = 2
    kind[[ord(c) for c in ".!?"]] = 3
    kind[[ord(c) for c in ",;:"]] = 4
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind[data] == 1, out=upper[1:])
    size = end - start
    capitals = upper[end] - upper[start]
    case = np.where(capitals == 0, 0, np.where(2 * capitals > size, 2, 1))
    same = np.zeros(len(start), np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    last = kind[data[end - 1]]
    before = kind[data[np.maximum(end - 2, start)]]
    length = np.minimum(np.log2(size).astype(np.int64), 5)
    return ((((case * 6 + length) * 6 + kind[data[start]]) * 6 + last) * 6 + before) * 2 + same


def _hash(values: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (mix(values.astype(np.uint64) + np.uint64(salt << 56)) >> np.uint64(64 - bits)).astype(np.int32)


def features_of(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sorted distinct n-gram numbers of a text's bytes; a long text is read in slices that end at spaces."""
    flags = np.zeros(1 << bits, bool)
    at, n_words = 0, 0
    while at < len(data):
        to = min(len(data), at + SEGMENT)
        while to < len(data) and not SPACE[data[to]]:
            gap = np.flatnonzero(SPACE[data[to : to + SEGMENT]])
            to = to + int(gap[0]) if len(gap) else min(len(data), to + SEGMENT)
        part = data[at:to]
        hashes, start, end = _segment_words(part, np.zeros(0, np.int64), False)
        n_words += len(start)
        if len(start):
            shapes = _shapes(part, start, end, hashes)
            flags[_hash(hashes, 1, bits)] = True
            flags[_hash(shapes, 2, bits)] = True
            flags[_hash(hashes[1:] * np.uint64(3) + hashes[:-1], 3, bits)] = True
            flags[_hash(shapes[1:] * 16384 + shapes[:-1], 4, bits)] = True
            flags[_hash((shapes[2:] * 16384 + shapes[1:-1]) * 16384 + shapes[:-2], 5, bits)] = True
        wide = part.astype(np.int64)
        if len(part) > 2:
            flags[_hash(wide[2:] * 65536 + wide[1:-1] * 256 + wide[:-2], 6, bits)] = True
        at = to
    flags[_hash(np.array([int(np.log2(n_words + 1) * 2)]), 7, bits)] = True
    return np.flatnonzero(flags).astype(np.int32)


def _each(column) -> Iterator[np.ndarray]:
    data, offsets = text_buffers(column)
    for i, j in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[i:j]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features_of(x).tobytes() for x in _each(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """Weights with the log-count ratios multiplied in, the ratios, and the sigmoid."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        r = self.ratios[features]
        norm = np.sqrt((r * r).sum())
        return float(self.weights[features].sum() / norm + self.bias) if norm > 0 else self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -35, 35))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int, smoothing: float) -> np.ndarray:
    counts = np.full((2, 1 << bits), smoothing)
    for x, y in zip(rows, labels, strict=True):
        counts[y, x] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratios = np.log(share[1] / share[0])
    ratios[(counts[0] == smoothing) & (counts[1] == smoothing)] = 0.0
    return ratios


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum cost * hinge(y, w x + b), the bias as a feature of value 1."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (v @ w[x] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset by Newton steps with smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, d = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(d * margins**2).sum() + 1e-3, (d * margins).sum()], [(d * margins).sum(), d.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * margins).sum(), g.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = COST, epochs: int = EPOCHS) -> Model | None:
    """A model of labels 0 and 1; None unless both occur on both sides of the calibration split."""
    order = np.random.default_rng(3).permutation(len(rows))
    cut = int(len(rows) * (1 - CALIBRATION))
    train, rest = order[:cut], order[cut:]
    if len({*labels[train]}) < 2 or len({*labels[rest]}) < 2:
        return None
    ratios = log_count_ratios([rows[i] for i in train], labels[train], bits, SMOOTHING)
    values = []
    for i in train:
        v = ratios[rows[i]]
        values.append(v / max(np.sqrt((v * v).sum()), 1e-12))
    y = np.where(labels[train] == 1, 1.0, -1.0)
    costs = cost * len(train) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, bias = dual_coordinate_descent([rows[i] for i in train], values, y, costs, 1 << bits, epochs)
    model = Model(w * ratios, ratios, bias, 1.0, 0.0)
    model.slope, model.offset = sigmoid_fit(np.array([model.margin(rows[i]) for i in rest]), labels[rest])
    return model


# ---------------------------------------------------------------- the job


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits the model on a bounded sample of labelled rows that aren't held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").cast("int").alias("label"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    featured = bounded(rows).mapInArrow(_featured, f"doc_id {kind}, label int, features binary").orderBy("doc_id").collect()
    return fit([np.frombuffer(r["features"], np.int32) for r in featured], np.array([r["label"] for r in featured]))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            scores = [held.score(features_of(x)) if held else 0.5 for x in _each(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = bounded(docs).select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
