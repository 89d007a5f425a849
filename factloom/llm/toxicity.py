"""Toxicity: a convolutional text classifier trained in numpy.

Words are runs of letters and of characters beyond ASCII, A-Z as a-z. A word's embedding is the sum of hashed rows:
one of the word, and one of each of its beginnings of PREFIXES bytes, so that forms of a stem share most of it. FILTERS
filters of each of WIDTHS words slide over the text; the largest response of each in the whole text goes to a logistic
unit. Embeddings, filters and unit are fitted by gradient descent with steps that shrink by the gradients so far
(Adagrad). Rows of fewer than MIN_ROW_DOCS texts, and those whose presence tells so little of the label that it may be
chance, are left out; the others begin in the label's direction. How much they must tell (the root of their likelihood
ratio) is the one of SIGNALS that does best on the rows kept for calibration.

A part of the labelled rows is kept from the fit for calibration: a slope for all, and the threshold of each language
that gives the best F1 there, or that of all rows if the language has too few of a class. A text's language is the one
whose common words it has the most of; the column lang is never read. A score is the sigmoid of slope times the distance
to the language's threshold, so 0.5 is that threshold.

The fit reads at most SAMPLE labelled rows of SAMPLE_CHARS characters in total, those of the smallest id hashes, none of
them held out; model and thresholds come from these rows. Every document is scored, whole, with the broadcast model,
whose size BITS and DIMENSIONS fix.

Defined cases: null and empty texts are scored as a text without words; labels that are null or of held-out ids are left
out and of contradicting labels the larger counts; of several texts of a labelled id the least is used; without labels
of both classes on both sides of the split all scores are 0.5; a null doc_id is scored and not held out; repeated rows
get the same score; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SEGMENT, Workspace, _tables, _values, bounded, mix, text_buffers
from factloom.llm.quality_classifier import held_out, sigmoid_fit
from factloom.llm.quality_rules import WORD_REFERENCES

SAMPLE, SAMPLE_CHARS = 6000, 48_000_000
BITS, DIMENSIONS, FILTERS, WIDTHS, PREFIXES = 19, 8, 8, (1, 2, 3), (4, 5, 6, 7)
STEPS, EPOCHS, RATE, SIGNALS, MIN_ROW_DOCS, CALIBRATION, MIN_OF_CLASS = 12_000, 6, 0.1, (0.0, 3.0, 4.0), 3, 0.25, 8
#: Bytes of short texts that are read side by side.
SLICE = 1 << 17
#: Letters in lower case, bytes beyond ASCII, and spaces for all else.
BYTES = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)], np.uint8)


# ---------------------------------------------------------------- words


def _part_rows(data: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of each word of mapped bytes (0: none), hashes and starts of the words; words also end where texts begin."""
    word = data != 32
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    if begins is not None:
        inside = begins[(begins > 0) & (begins < len(data))]
        first[inside] = word[inside]
        last[inside - 1] = word[inside - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, back = _tables(1 << max(SEGMENT.bit_length(), len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values(False)[data] * powers[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    rows = np.zeros((len(start), 1 + len(PREFIXES)), np.int32)
    shift = np.uint64(64 - BITS)
    rows[:, 0] = 1 + (mix(hashes) >> shift)
    for k, n in enumerate(PREFIXES, 1):
        has = np.flatnonzero(end - start >= n)
        s = start[has]
        rows[has, k] = 1 + (mix((total[s + n] - total[s]) * back[s] + np.uint64(n)) >> shift)
    return rows, hashes, start


def word_rows(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of the words of a text's bytes, in slices of about SEGMENT bytes that end between words."""
    data, at = BYTES[data], 0
    while at < len(data):
        to = min(len(data), at + SEGMENT)
        while to < len(data) and data[to] != 32:
            gap = np.flatnonzero(data[to : to + SEGMENT] == 32)
            to = to + int(gap[0]) if len(gap) else min(len(data), to + SEGMENT)
        yield _part_rows(data[at:to])[:2]
        at = to


@lru_cache(maxsize=1)
def _common_words() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, sorted hashes of their common words, and each language's shares of these."""
    shares = {lang: dict(zip(x.split()[::2], map(float, x.split()[1::2]), strict=True)) for lang, x in WORD_REFERENCES.items()}
    words = sorted({w for x in shares.values() for w in x})
    of = np.concatenate([_part_rows(BYTES[np.frombuffer(w.encode(), np.uint8)])[1] for w in words])
    table = np.array([[x.get(w, 0.0) / sum(x.values()) for w in words] for x in shares.values()])
    order = np.argsort(of)
    return list(shares), of[order], table[:, order]


def _language_votes(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How much of each language's common words there is among each of n texts' words; a last column, of no language, is barely above 0."""
    _, known, table = _common_words()
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    found = np.bincount(text[hit] * len(known) + at[hit], minlength=n * len(known)).reshape(n, len(known))
    return np.hstack([found @ table.T, np.full((n, 1), 1e-9)])


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """Embedding rows (the first is zero), filters by width, their biases, the logistic unit, and the calibration."""

    rows: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(WORD_REFERENCES) + 1))

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """The largest response of each filter to a text's words, as rows."""
        x = self.rows[ids].sum(axis=1)
        return np.concatenate([self._over(x, f).max(axis=0) for f in self.filters])

    @staticmethod
    def _over(x: np.ndarray, f: np.ndarray) -> np.ndarray:
        n = len(x) - len(f) + 1
        out = x[:n] @ f[0]
        for k in range(1, len(f)):
            out += x[k : k + n] @ f[k]
        return out

    def unit(self, responses: np.ndarray) -> float:
        return float(np.maximum(responses + self.biases, 0) @ self.weights + self.bias)

    def margin(self, data: np.ndarray) -> tuple[float, int]:
        """The unit's value for a text's bytes, and its language."""
        none = np.zeros((max(WIDTHS) - 1, 1 + len(PREFIXES)), np.int32)
        best, votes, edge = np.full(len(self.biases), -np.inf, np.float32), _language_votes(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)[0], none
        for ids, hashes in word_rows(data):
            if len(ids):
                votes += _language_votes(hashes, np.zeros(len(ids), np.int64), 1)[0]
                ids = np.concatenate([edge, ids])  # filters reach across slices
                edge = ids[-len(none) :]
                best = np.maximum(best, self.responses(ids))
        return self.unit(np.maximum(best, self.responses(np.concatenate([edge, none])))), int(votes.argmax())

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for several texts side by side, parted by rows of zeros as wide as no filter."""
        n, gap = len(offsets) - 1, max(WIDTHS) - 1
        ids, hashes, start = _part_rows(BYTES[data[offsets[0] : offsets[-1]]], offsets[:-1] - offsets[0])
        text = np.searchsorted(offsets[1:-1] - offsets[0], start, "right")
        x = np.zeros((len(ids) + gap * (n + 1), DIMENSIONS), np.float32)
        place = np.arange(len(ids)) + gap * (text + 1)
        for k in range(ids.shape[1]):
            x[place] += self.rows[ids[:, k]]
        begins = np.searchsorted(start, offsets[:-1] - offsets[0]) + gap * np.arange(n)
        tops = []
        for f in self.filters:
            size = len(x) - len(f) + 1
            z = f[0].T @ x[:size].T
            for k in range(1, len(f)):
                z += f[k].T @ x[k : k + size].T
            tops.append(np.maximum.reduceat(z, begins, axis=1))
        units = np.maximum(np.concatenate(tops).T + self.biases, 0) @ self.weights + self.bias
        return units, _language_votes(hashes, text, n).argmax(axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of texts data[offsets[i]:offsets[i + 1]]; short ones are read side by side, SLICE bytes at a time."""
        out, lo, n = np.zeros(len(offsets) - 1), 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
            if hi == lo + 1:
                m, k = self.margin(data[offsets[lo] : offsets[hi]])
            else:
                m, k = self.margins(data, offsets[lo : hi + 1])
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(self.slope * (m - self.thresholds[k]), -35, 35)))
            lo = hi
        return out


def padded(ids: np.ndarray) -> np.ndarray:
    """Rows of zeros before and after, as many as the widest filter reaches beyond a word."""
    none = np.zeros((max(WIDTHS) - 1, ids.shape[1]), np.int32)
    return np.concatenate([none, ids, none])


def label_signal(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Signed root of the likelihood ratio of a row's presence and the label; seen and texts are counts by label."""
    n, out = texts.sum(), np.zeros(seen.shape[1])
    with_row = seen.sum(axis=0)
    for label in (0, 1):
        for found, expected in ((seen[label], with_row * (texts[label] / n)), (texts[label] - seen[label], (n - with_row) * (texts[label] / n))):
            has = found > 0
            out[has] += 2 * found[has] * np.log(found[has] / expected[has])
    return np.sqrt(np.maximum(out, 0)) * np.where(seen[1] * texts[0] > seen[0] * texts[1], 1, -1)


def train_network(texts: list[np.ndarray], y: np.ndarray, least_signal: float, epochs: int | None = None, rate: float = RATE, seed: int = 5) -> Model:
    """Fits the network to texts (padded rows of words) by one text a step, STEPS or EPOCHS rounds at least; the classes weigh the same."""
    epochs = epochs or max(EPOCHS, STEPS // len(texts))
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, (1 << BITS) + 1), np.int32)
    for ids, label in zip(texts, y, strict=True):
        seen[label, np.unique(ids)] += 1
    signal = label_signal(seen, np.bincount(y, minlength=2))
    alive = (np.abs(signal) >= least_signal) & (seen.sum(axis=0) >= MIN_ROW_DOCS)
    alive[0] = False
    texts = [np.where(alive[ids], ids, 0) for ids in texts]
    rows = np.zeros((len(signal), DIMENSIONS), np.float32)
    rows[alive] = rng.normal(0, 0.1, (int(alive.sum()), DIMENSIONS))
    rows[alive, 0] += signal[alive] / 10
    filters = [rng.normal(0, np.sqrt(2 / (w * DIMENSIONS)), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    n = FILTERS * len(WIDTHS)
    model = Model(rows, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32))
    square = {"rows": np.full_like(rows, 1e-2), "biases": np.full(n, 1e-2, np.float32), "weights": np.full(n, 1e-2, np.float32), "bias": 1e-2}
    squares = [np.full_like(f, 1e-2) for f in filters]
    cost = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    each = np.arange(FILTERS)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            ids = texts[i]
            x = rows[ids].sum(axis=1)
            at, top = [], np.empty(n, np.float32)
            for k, f in enumerate(filters):
                z = Model._over(x, f)
                at.append(z.argmax(axis=0))
                top[k * FILTERS : (k + 1) * FILTERS] = z[at[k], each]
            raw = top + model.biases
            h = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ model.weights + model.bias, -35, 35)))
            g = np.float32(cost[i] * (p - y[i]))
            if abs(g) < 1e-3:
                continue
            back = g * model.weights * (raw > 0)
            for name, grad in (("weights", g * h), ("biases", back)):
                square[name] += grad * grad
                setattr(model, name, getattr(model, name) - rate * grad / np.sqrt(square[name]))
            square["bias"] += g * g
            model.bias -= rate * g / np.sqrt(square["bias"])
            touched, steps = [], []
            for k, f in enumerate(filters):
                b = back[k * FILTERS : (k + 1) * FILTERS]
                grads = np.stack([(x[at[k] + o] * b[:, None]).T for o in range(len(f))])
                for o in range(len(f)):
                    own = ids[at[k] + o]
                    touched.append(own.ravel())
                    steps.append(np.repeat(b[:, None] * f[o].T, own.shape[1], axis=0))
                squares[k] += grads * grads
                f -= rate * grads / np.sqrt(squares[k])
            which, place = np.unique(np.concatenate(touched), return_inverse=True)
            grad = np.zeros((len(which), DIMENSIONS), np.float32)
            np.add.at(grad, place, np.concatenate(steps))
            square["rows"][which] += grad * grad
            rows[which] -= rate * grad / np.sqrt(square["rows"][which])
            rows[0] = 0
    return model


def best_threshold(margins: np.ndarray, y: np.ndarray) -> float:
    """The margin from which predicting 1 gives the best F1, in the widest gap that does; nearer to the class of more rows, whose edge is known better."""
    order = np.argsort(-margins, kind="stable")
    m, hit = margins[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(m) + 1) + y.sum())
    f1[:-1][m[:-1] == m[1:]] = -1  # equal margins aren't told apart
    gaps = np.append(m[:-1] - m[1:], 1.0)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[gaps[best].argmax()]
    few, many = np.sqrt(y.sum()), np.sqrt((1 - y).sum())
    return float(m[k] - gaps[k] * many / max(few + many, 1))


def fit(texts: list[np.ndarray], y: np.ndarray) -> Model | None:
    """A calibrated model of texts (bytes) and labels 0 and 1; None unless both occur on both sides of the split."""
    order = np.random.default_rng(3).permutation(len(texts))
    cut = int(len(texts) * (1 - CALIBRATION))
    train, rest = order[:cut], order[cut:]
    if len({*y[train]}) < 2 or len({*y[rest]}) < 2:
        return None
    none = [np.zeros((0, 1 + len(PREFIXES)), np.int32)]
    words, truth = [padded(np.concatenate(none + [r for r, _ in word_rows(texts[i])])) for i in train], y[rest]
    best = np.inf
    for signal in SIGNALS:
        tried = train_network(words, y[train], signal)
        found = [tried.margin(texts[i]) for i in rest]
        tried.slope, offset = sigmoid_fit(np.array([m for m, _ in found]), truth)
        loss = np.mean([np.logaddexp(0, -(2 * t - 1) * (tried.slope * m + offset)) for (m, _), t in zip(found, truth, strict=True)])
        if loss < best:
            best, model, margins, langs = loss, tried, np.array([m for m, _ in found]), np.array([k for _, k in found])
    model.thresholds[:] = best_threshold(margins, truth)
    for k in range(len(model.thresholds)):
        own = langs == k
        if min(truth[own].sum(), (1 - truth[own]).sum()) >= MIN_OF_CLASS:
            model.thresholds[k] = best_threshold(margins[own], truth[own])
    return model


# ---------------------------------------------------------------- the job


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model | None:
    """Fits the model on a bounded sample of labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("h").alias("h"))
    work = Workspace(docs.sparkSession, "toxicity")
    rows = work.table(rows.withColumn("n", F.coalesce(F.length("text"), F.lit(0))), "sample")
    sizes = rows.select("h", "doc_id", "n").orderBy("h", "doc_id").collect()
    within = np.cumsum([r["n"] for r in sizes]) <= chars
    if not within.any():
        return None
    most = sizes[int(within.sum()) - 1]["h"]
    used = rows.filter(F.col("h") <= most).select("doc_id", "h", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "label").orderBy("h", "doc_id").collect()
    model = fit([np.frombuffer(r["text"], np.uint8) for r in used], np.array([r["label"] for r in used]))
    work.keep_only()
    return model


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            scores = held.scores(data, offsets) if held else np.full(len(offsets) - 1, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = bounded(docs).select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
