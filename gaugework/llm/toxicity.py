"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

An n-gram counts once in a text. Its log-count ratio r compares how often it is met in toxic and in clean
labelled texts; the classifier is a logistic regression on the features r * (presence). A text of up to WINDOW
bytes is scored as a whole; a longer one window by window, to its end, and gets the highest window's score, so
that a few toxic words in a long text are not outweighed by the rest.

The model is fitted on the driver from at most MOST_TOXIC + MOST_CLEAN labelled texts, chosen by a hash of
doc_id; weights restore the classes' shares among all labels. A text takes at most 2**BITS features. Fitting
and scoring read texts whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, blocks, frugal, utf8

#: Bounds of the labelled sample.
MOST_TOXIC, MOST_CLEAN = 1000, 2000
#: n-gram lengths in bytes and the bits of a bucket; WINDOW and STEP in bytes.
ORDERS, BITS = (4, 5), 18
WINDOW, STEP = 2048, 1024
BLOCK, PART = 1 << 20, 1 << 19


@dataclass
class Model:
    weights: np.ndarray  # by bucket, ratio included
    bias: float


def _fold(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every white space a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table[data]


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each byte (those over the end: absent)."""
    h, found = Rolling(data), []
    for n in ORDERS:
        start = np.arange(max(0, len(data) - n + 1))
        found.append((h(start, start + n) >> np.uint64(64 - BITS)).astype(np.int32))
    return found


def _windows(size: int) -> list[tuple[int, int]]:
    """The windows of a text; a last window reaches to its end, so every byte is in one."""
    if size <= WINDOW:
        return [(0, size)]
    starts = list(range(0, size - WINDOW, STEP)) + [size - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _present(grams: list[np.ndarray], start: int, stop: int, seen: np.ndarray) -> np.ndarray:
    """The distinct buckets of the n-grams within [start, stop)."""
    parts = [g[start : max(start, stop - n + 1)] for g, n in zip(grams, ORDERS)]
    all_ = np.concatenate(parts)
    order = np.arange(len(all_), dtype=np.int32)
    seen[all_] = order
    return all_[seen[all_] == order]


def features(batches):
    """Per labelled text: its label and its distinct buckets, as int32 bytes."""
    seen = np.zeros(1 << BITS, np.int32)
    for batch in batches:
        data, at = utf8(batch.column("text"))
        labels, rows = batch.column("toxic").to_pylist(), []
        for i, label in enumerate(labels):
            text = _fold(data[at[i] : at[i + 1]])
            rows.append((label, np.sort(_present(_grams(text), 0, len(text), seen)).tobytes()))
        yield pa.RecordBatch.from_pydict({"toxic": pa.array([r[0] for r in rows], pa.int32()), "buckets": pa.array([r[1] for r in rows], pa.binary())})


def fit_model(labels: np.ndarray, rows: list[np.ndarray], share: float, rounds: int = 40, ridge: float = 1.0) -> Model:
    """Naive Bayes ratios, then a logistic regression by L-BFGS. share: of toxic among all labels."""
    m = 1 << BITS
    if len(labels) == 0 or labels.min() == labels.max():
        p = 0.5 if len(labels) == 0 else float(labels[0] * 0.98 + 0.01)
        return Model(np.zeros(m, np.float32), float(np.log(p / (1 - p))))
    y = labels.astype(float)
    share = min(max(share, 0.01), 0.99)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    p, q, seen = np.ones(m), np.ones(m), np.zeros(m, np.int32)
    for label, row in zip(labels, rows):
        (p if label else q)[row] += 1  # a row has a bucket once
        seen[row] += 1
    ratio = np.where(seen >= 3, np.log(p / p.sum() * q.sum() / q), 0.0)
    norm = 8 / np.sqrt(np.maximum(1, [len(r) for r in rows]))
    parts, start = [], 0  # the rows in parts of about PART buckets, so that no array is as long as all of them
    ends = np.cumsum([len(r) for r in rows])
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART, "right")))
        sizes = np.array([len(r) for r in rows[start:stop]])
        parts.append((start, stop, np.concatenate(rows[start:stop]), np.cumsum(sizes) - sizes, sizes))
        start = stop

    def loss(v):
        u, z, grad = v[:m] * ratio, np.empty(len(y)), np.zeros(m)
        for a, b, idx, first, sizes in parts:
            sums = np.concatenate([[0.0], np.cumsum(u[idx])])
            z[a:b] = (sums[first + sizes] - sums[first]) * norm[a:b]
        z += v[m]
        value = (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + ridge / 2 * (v[:m] ** 2).sum()
        err = weight * (1 / (1 + np.exp(-z)) - y)
        for a, b, idx, _, sizes in parts:
            grad += np.bincount(idx, np.repeat((err * norm)[a:b], sizes), m)
        return value, np.append(grad * ratio + ridge * v[:m], err.sum())

    v = _lbfgs(loss, np.append(np.zeros(m), np.log(share / (1 - share))), rounds)
    return Model((v[:m] * ratio * 8).astype(np.float32), float(v[m]))


def _lbfgs(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, t in reversed(past):
            a = (s @ d) / (s @ t)
            alphas.append(a)
            d = d - a * t
        if past:
            s, t = past[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t), a in zip(past, reversed(alphas)):
            d = d + s * (a - (t @ d) / (s @ t))
        slope, step = g @ d, 1.0 if past else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        if slope >= 0:
            break
        for _ in range(25):
            new = x + step * d
            value2, g2 = f(new)
            if value2 <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (pair := (new - x, g2 - g))[0] @ pair[1] > 1e-12:
            past = [*past, pair][-memory:]
        done = value - value2 < 1e-6 * abs(value)
        x, value, g = new, value2, g2
        if done:
            break
    return x


def scores(model: Model, data: np.ndarray, at: np.ndarray, seen: np.ndarray) -> np.ndarray:
    found = np.zeros(len(at) - 1)
    w, data = model.weights, _fold(data)
    for first, last in blocks(at, BLOCK):
        base = at[first]
        grams = _grams(data[base : at[last]])
        for i in range(first, last):
            best = -np.inf
            for s, e in _windows(int(at[i + 1] - at[i])):
                own = _present(grams, int(at[i] - base) + s, int(at[i] - base) + e, seen)
                best = max(best, float(w[own].sum()) / np.sqrt(max(1, len(own))))
            found[i] = best + model.bias
    return 1 / (1 + np.exp(-np.clip(found, -40, 40)))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows that are not held out; a document with several labels is toxic if one says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    pick = F.xxhash64(F.lit("toxicity"), "doc_id")
    some = known.where("toxic = 1").orderBy(pick, "doc_id").limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(pick, "doc_id").limit(MOST_CLEAN))
    some = some.select(F.col("doc_id").alias("_sample_id"), "toxic")  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_sample_id"))
    rows = texts.select("text", F.col("toxic").cast("int")).mapInArrow(features, "toxic int, buckets binary").toArrow()
    y = rows.column("toxic").to_numpy()
    lists = [np.frombuffer(b, np.int32) for b in rows.column("buckets").to_pylist()]
    order = sorted(range(len(y)), key=lambda i: (y[i], lists[i].tobytes()[:256], len(lists[i])))  # the result must not depend on the order of tasks
    return fit_model(y[order], [lists[i] for i in order], (toxic or 0) / max(1, total))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, none for an empty table.

    Null or empty text is scored by the model's bias. Rows that repeat are scored alike. A score of exactly 0.5 is
    predicted toxic. A null doc_id counts as the empty text for held_out. Other columns of docs, whatever their names, are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            found = scores(shared.value, data, at, seen)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below ``most``, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            yield batch.filter(pa.array(scores(shared.value, data, at, seen) < most))

    return docs.mapInArrow(frugal(run), docs.schema)
