"""Quality classification with naive Bayes support vectors.

Features are indicators of n-grams: words and word pairs, and n-grams of token shapes.  A
shape says what kinds of characters a token has and whether it repeats an earlier token;
a repeat that goes on as the text went on there counts its length, so that copied lines
and stuttering show as n-grams as well.  All are hashed into :data:`DIMENSIONS` places.
Each indicator is scaled by the log-count ratio of the two classes, each vector to unit
length, and dual coordinate descent fits a linear hinge-loss model.  A logistic fit on
rows that the descent did not see turns margins into scores.

The fit uses a bounded sample of labelled rows, :data:`SAMPLE_ROWS` in expectation, drawn by
a hash of the id; every text is scored whole.

Nulls and ties: a null text counts as empty and gets the score of a text without features.
Labels that are null are left out.  Without labels every score is 0.5; with one class
only, every score is that class's smoothed share.  Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import mixed, prefix_hashes, span_hashes, steps, text_or_empty, utf8
from lapidary.llm.language_id import logistic

WORD_BITS = 17
SHAPE_BITS = 12
DIMENSIONS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
SAMPLE_ROWS = 6_000
#: Share of the sample that calibrates.
CALIBRATION = 0.25
EPOCHS = 12
COST = 1.0
#: Words that fewer sampled rows have tell nothing.
LEAST_ROWS = 3
PREDICT_FROM = 0.7

#: Kinds of bytes: 1 lower case or beyond ASCII, 2 upper case, 4 digit, 8 punctuation within sentences, 16 other symbols.
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = 16
KINDS[0x30:0x3A] = 4
KINDS[0x41:0x5B] = 2
KINDS[0x61:0x7B] = 1
KINDS[0x80:] = 1
KINDS[[ord(c) for c in ".,;:?'\"()-"]] = 8
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every indicator that is on, for texts that stand end to end."""
    rows = len(bounds) - 1
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    row = np.searchsorted(bounds, starts, side="right") - 1
    word = span_hashes(prefix_hashes(data), starts, ends)
    # Shape: the kinds of characters, which kind ends the token, and how long it is.
    kinds = np.bitwise_or.reduceat(KINDS[data], starts).astype(np.int64)
    length = np.minimum(np.log2(ends - starts).astype(np.int64), 6)
    shape = (kinds << 5 | KINDS[data[ends - 1]]) << 3 | length
    # How far back the token last stood in its text, and for how long it has stood as far back.
    order = np.lexsort((word, row))
    same = (word[order][1:] == word[order][:-1]) & (row[order][1:] == row[order][:-1])
    gap = np.zeros(len(word), np.int64)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    goes_on = np.zeros(len(word), bool)
    goes_on[1:] = (gap[1:] > 0) & (gap[1:] == gap[:-1]) & (row[1:] == row[:-1])
    last_break = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(word))))
    run = np.arange(len(word)) - last_break
    lasting = np.where(goes_on, np.log2(np.maximum(run, 1)).astype(np.int64) + 2, (gap > 0).astype(np.int64))
    nearness = np.where(goes_on, np.minimum(np.log2(np.maximum(gap, 1)).astype(np.int64), 7), 0)
    repeat = lasting << 3 | nearness
    second, third = row[1:] == row[:-1], row[2:] == row[:-2]

    def shaped(value: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(value.astype(np.uint64) * np.uint64(8) + np.uint64(kind)) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)

    small = [
        (row, shaped(shape, 0)),
        (row, shaped(repeat, 1)),
        (row[1:][second], shaped(shape[:-1] << 16 | shape[1:], 2)[second]),
        (row[2:][third], shaped(shape[:-2] << 32 | shape[1:-1] << 16 | shape[2:], 3)[third]),
    ]
    on = np.zeros(rows << SHAPE_BITS, bool)
    for r, f in small:
        on[r << SHAPE_BITS | f] = True
    flat = np.flatnonzero(on)
    pair = mixed(word[:-1] * np.uint64(3) + word[1:])[second]
    words = np.concatenate([row << WORD_BITS | (word >> np.uint64(64 - WORD_BITS)).astype(np.int64), row[1:][second] << WORD_BITS | (pair >> np.uint64(64 - WORD_BITS)).astype(np.int64)])
    words = np.unique(words)
    all_rows = np.concatenate([flat >> SHAPE_BITS, words >> WORD_BITS])
    all_features = np.concatenate([flat & ((1 << SHAPE_BITS) - 1), (words & ((1 << WORD_BITS) - 1)) + (1 << SHAPE_BITS)])
    return all_rows, all_features


@dataclass
class Model:
    weights: np.ndarray  # of each indicator, with its log-count ratio
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(row, self.ratios[feature] ** 2, rows))
        return np.bincount(row, self.weights[feature], rows) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out, done = np.zeros(len(texts)), 0
        for part in steps(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            data, bounds = utf8(part.column(0))
            margin = self.margins(*features(data, bounds), part.num_rows)
            out[done : done + part.num_rows] = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))
            done += part.num_rows
        return out


def constant(share: float) -> Model:
    return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model, by dual coordinate descent."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([(v * v).sum() + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            f, v = rows[i], values[i]
            slope = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_rows(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """A model from the features of each sampled row and its label (0 or 1)."""
    if not len(rows) or label.min() == label.max():
        return constant((label.sum() + 1) / (len(rows) + 2) if len(rows) else 0.5)
    held = np.arange(len(rows)) % max(2, round(1 / CALIBRATION)) == 0
    if label[~held].min() == label[~held].max():
        held[:] = False
    counts = np.zeros((2, DIMENSIONS))
    for f, y in zip((r for r, h in zip(rows, held, strict=True) if not h), label[~held], strict=True):
        counts[y][f] += 1
    share = (counts + 1) / (np.bincount(label[~held], minlength=2)[:, None] + 2)
    ratios = np.where(counts.sum(0) >= LEAST_ROWS, np.log(share[1] / share[0]), 0.0)

    def vector(f: np.ndarray) -> np.ndarray:
        v = ratios[f]
        return v / max(np.sqrt((v * v).sum()), 1e-9)

    train = [r for r, h in zip(rows, held, strict=True) if not h]
    y = np.where(label[~held] == 1, 1.0, -1.0)
    each = np.bincount(label[~held], minlength=2)
    cost = COST * len(y) / (2 * each[label[~held]])
    w, bias = coordinate_descent(train, [vector(f) for f in train], y, cost)
    model = Model((w * ratios).astype(np.float32), ratios.astype(np.float32), bias, 1.0, 0.0)
    rest = [i for i in range(len(rows)) if held[i]] or list(range(len(rows)))
    margin = np.array([w[rows[i]] @ vector(rows[i]) + bias for i in rest])
    model.slope, model.offset = logistic(label[rest] == 1, margin)
    return model


def feature_udf() -> Callable[[Column], Column]:
    @F.arrow_udf("array<int>")
    def udf(texts: pa.Array) -> pa.Array:
        parts = []
        for part in steps(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            row, feature = features(*utf8(part.column(0)))
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(part.num_rows + 1))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature[order], pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return udf


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality)."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    found = rows.select(F.xxhash64("doc_id", F.lit(1)).alias("o"), "quality", feature_udf()(text_or_empty()).alias("f")).toArrow().sort_by("o")
    lists = found.column("f").combine_chunks()
    flat, ends = (np.asarray(lists.values), np.asarray(lists.offsets)) if len(lists) else (np.zeros(0, np.int32), [0])
    return fit_rows([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], found.column("quality").to_numpy().astype(np.int64))


def score_udf(model: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("double")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.scores(texts), pa.float64())

    return udf


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted (1 from PREDICT_FROM on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*kept, score_udf(sent)(text_or_empty()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))


def accepted(docs: DataFrame, model: Model, at_least: float) -> DataFrame:
    """The rows of docs whose score is at_least or more, with the columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.filter(score_udf(sent)(text_or_empty()) >= at_least)
