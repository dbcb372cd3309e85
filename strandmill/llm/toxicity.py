"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learn from document labels alone.

A sentence's score is logistic in the hashed words and word prefixes that it holds; a document is toxic unless none of
its sentences is: 1 - prod(1 - p). The gradient of the document's likelihood reaches each sentence through that
product, so the labels of documents come to mark the sentences at fault. Training takes at most TRAIN_ROWS labelled
rows (a documented bound; choice by a hash of the id) in one task; scoring reads every whole text.

Defined cases: a null text is an empty text, which has no sentence and scores 0; null labels are left out; repeated
rows count once each; without any usable label every score is 0; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.llm.features import fold, labelled_sample
from strandmill.llm.textkit import U64, lower, mix, word_hashes, words

BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 5
RATE = 0.5
L1, L2 = 2.5, 0.01
BIAS = -6.0
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCS = 4
THRESHOLD = 0.7
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[b for b in range(0x21, 0x80) if not chr(b).isalnum()]] = True


def sentences(data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """(buckets, sentence_of, row_of, begin, end) of the texts: the hashed features, the sentence of each feature, the
    row of each sentence and its byte range. A sentence ends at a word that ends in . ! or ?, at a line's end and at the text's end."""
    starts, ends, first = words(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    closes = _END[data[ends - 1]]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    closes[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (row[1:] != row[:-1])
    closes[-1] = True
    sentence = np.concatenate([[0], np.cumsum(closes)[:-1]])
    last = np.flatnonzero(closes)
    begin = starts[np.concatenate([[0], last[:-1] + 1])]
    # Words without ASCII punctuation at their ends.
    low = lower(data)
    a, b = starts.copy(), ends.copy()
    for _ in range(4):
        a += (a < b) & _EDGE[low[np.minimum(a, len(low) - 1)]]
        b -= (b > a) & _EDGE[low[np.maximum(b - 1, 0)]]
    found, of = [mix(word_hashes(low, a, b) + U64(1))], [sentence]
    for k in PREFIXES:
        some = b - a >= k
        found.append(mix(word_hashes(low, a[some], a[some] + k) + U64(100 + k)))
        of.append(sentence[some])
    buckets = (np.concatenate(found) >> U64(64 - bits)).astype(np.int64)
    return buckets, np.concatenate(of), row[last], begin, ends[last]


def _probability(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights with the bias last. sample: text, target (0 or 1), luck (order of learning)."""

    def learn(batches):
        size = 1 << bits
        docs = []
        for batch in batches:
            targets = batch.column("target").to_pylist()
            for lo, hi, data, offsets in textkit.pieces(batch.column("text")):
                buckets, of, row, _, _ = sentences(data, offsets, bits)
                key = textkit.distinct(of * size + buckets)  # a feature counts once a sentence
                of, buckets = key // size, key % size
                owner = row[of] if len(of) else of
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    own = slice(cut[r], cut[r + 1])
                    if cut[r + 1] > cut[r]:
                        docs.append((buckets[own].astype(np.int32), (of[own] - of[cut[r]]).astype(np.int32), targets[lo + r]))
        # A feature of fewer than LEAST_DOCS training texts can only memorise them.
        seen = np.zeros(size, np.int64)
        for at, _, _ in docs:
            seen[textkit.distinct(at)] += 1
        common = seen >= LEAST_DOCS
        docs = [(at[kept], of[kept], y) for at, of, y in docs for kept in [common[at]]]
        # Follow-the-regularised-leader steps: the L1 term leaves a feature at 0 until its summed gradient exceeds it.
        z, n, bias, bias_squares = np.zeros(size), np.zeros(size), BIAS, 1.0

        def weights_at(i):
            return np.where(np.abs(z[i]) <= L1, 0.0, (z[i] - np.sign(z[i]) * L1) / ((1.0 + np.sqrt(n[i])) / RATE + L2))

        for _ in range(epochs):
            for at, of, y in docs:
                if not len(at):
                    continue
                p = _probability(np.bincount(of, weights_at(at)) + bias)
                if y:  # d log(1 - prod(1 - p)) / d logit = p * prod / (1 - prod), in safe form
                    none = np.exp(np.sum(np.log1p(-np.minimum(p, 1 - 1e-12))))
                    slope = p * none / max(1 - none, 1e-9)
                else:
                    slope = -p
                hit, where = np.unique(at, return_inverse=True)
                g = np.bincount(where, slope[of])
                w = weights_at(hit)
                z[hit] += g + (np.sqrt(n[hit] + g * g) - np.sqrt(n[hit])) / RATE * w
                n[hit] += g * g
                total = float(slope.sum())
                bias_squares += total * total
                bias = min(bias + 0.05 * total / np.sqrt(bias_squares), -5.0)  # a sentence with nothing known stays clean
            # Features whose summed gradient stayed far from the L1 term no longer take part.
            live = np.abs(z) > L1 / 4
            docs = [(at[kept], of[kept], y) for at, of, y in docs for kept in [live[at]]]
        w = weights_at(slice(None))
        weights = np.append(w, bias if docs else -35.0).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    rows = sample.repartition(1).sortWithinPartitions("luck", "target", "text").mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(rows[0]["weights"], np.float32) if rows else np.append(np.zeros(1 << bits, np.float32), np.float32(-35.0))


def _scored(data, offsets, w):
    """(row, begin, end, logit) of every sentence."""
    bits = int(len(w) - 1).bit_length() - 1
    buckets, of, row, begin, end = sentences(data, offsets, bits)
    key = textkit.distinct((of << bits) + buckets)
    sums = np.bincount(key >> bits, w[key & ((1 << bits) - 1)], minlength=len(row)) if len(row) else np.zeros(0)
    return row, begin, end, sums + w[-1]


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score, worst (byte offset and length of the most toxic sentence, null where there is none) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches):
        w = shared.value
        for batch in batches:
            n = batch.num_rows
            scores, at, size = np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.int64)
            for lo, hi, data, offsets in textkit.pieces(batch.column("text")):
                row, begin, end, logit = _scored(data, offsets, w)
                p = _probability(logit)
                clear = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=hi - lo) if len(row) else np.zeros(hi - lo)
                scores[lo:hi] = -np.expm1(clear)
                order = np.lexsort((-begin, logit, row))
                top = order[np.flatnonzero(np.diff(row[order], append=-1))] if len(row) else order
                at[lo + row[top]], size[lo + row[top]] = begin[top] - offsets[row[top]], (end - begin)[top]
            none = at < 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(at, mask=none), pa.array(size, mask=none)], ["doc_id", "score", "worst_at", "worst_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double, worst_at long, worst_bytes long")


def offending(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """doc_id, sentence, score of every sentence that scores least or more by itself."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches):
        w = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, data, offsets in textkit.pieces(batch.column("text")):
                row, begin, end, logit = _scored(data, offsets, w)
                p = _probability(logit)
                some = np.flatnonzero(p >= least)
                text = [data[begin[i] : end[i]].tobytes().decode("utf-8", "replace") for i in some]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[some] + lo)), pa.array(text, pa.string()), pa.array(p[some])], ["doc_id", "sentence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, sentence string, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the place of the worst sentence for every document; learns labels.toxic from the rows
    whose crc32(doc_id) mod 3 is not 1."""
    weights = train(labelled_sample(docs, labels, "toxic", 3, 1, TRAIN_ROWS))
    return score(docs, weights).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_at", "worst_bytes")
