"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader updates.

Training takes at most TRAIN_ROWS labelled rows (a documented bound; choice by a hash of the id) in one task, which
learns as rows stream in and keeps only their hashed features. Scoring is a sparse dot product of the broadcast weights
(2**BITS floats, 4 MB at the default) with the n-gram frequencies of each whole text, at any size of input.

Defined cases: a null text is an empty text; an empty text scores the bias alone; null labels are left out; rows
repeated in labels or documents count once each; without any usable label every score is 0.5; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.llm.features import fold, labelled_sample, word_ngrams

BITS = 20
TRAIN_ROWS = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-5, 1e-4
SCALE = 8.0
THRESHOLD = 0.7


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for logistic loss; the last coordinate is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at, x, y: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(w @ x) - y) * x
        squares = g * g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + squares) - np.sqrt(n)) / ALPHA * w
        self.n[at] += squares


def sparse_rows(column, bits: int):
    """(buckets, frequencies) of each text, the bias last."""
    for _, _, data, offsets in textkit.pieces(column):
        buckets, first = word_ngrams(data, offsets, bits)
        for r in range(len(first) - 1):
            at, count = np.unique(buckets[first[r] : first[r + 1]], return_counts=True)
            yield np.append(at, 1 << bits), np.append(count * (SCALE / max(1, first[r + 1] - first[r])), 1.0)


def train(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights with the bias last. sample: text, target (0 or 1), luck (order of learning)."""

    def learn(batches):
        model, rows = Ftrl(1 << bits), []
        for batch in batches:
            for (at, x), y in zip(sparse_rows(batch.column("text"), bits), batch.column("target").to_pylist(), strict=True):
                rows.append((at.astype(np.int32), x.astype(np.float32), y))
        for _ in range(epochs):
            for at, x, y in rows:
                model.learn(at, x, y)
        weights = model.weights(slice(None)).astype(np.float32) if rows else np.zeros((1 << bits) + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    rows = sample.repartition(1).sortWithinPartitions("luck", "target", "text").mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(rows[0]["weights"], np.float32) if rows else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(len(weights) - 1).bit_length() - 1
    kept = [c for c in docs.columns if c != score_col]

    def apply(batches):
        w = shared.value
        for batch in batches:
            out = []
            for _, _, data, offsets in textkit.pieces(batch.column(text_col)):
                buckets, first = word_ngrams(data, offsets, bits)
                sums = np.concatenate([[0.0], np.cumsum(w[buckets], dtype=np.float64)])
                out.append(_sigmoid(SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first)) + w[-1]))
            scores = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], [*kept, score_col])

    schema = docs.select(*kept).schema.add(score_col, "double")
    return docs.select(*kept).mapInArrow(apply, schema)


def fitted(spark, docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Learns labels.quality from the rows whose crc32(doc_id) mod 4 is not 2."""
    return train(labelled_sample(docs, labels, "quality", 4, 2, TRAIN_ROWS))


def good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs that the classifier predicts to be good; its score meets no column of theirs."""
    scored = score(textkit.sealed(docs), weights)
    return textkit.unsealed(scored.where(F.col("score") >= THRESHOLD), docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights = fitted(docs.sparkSession, docs, labels)
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
