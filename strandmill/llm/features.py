"""Hashed features of texts for the two classifiers, and the bounded, reproducible choice of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.textkit import U64, cut, lower, mix, range_hash, word_hashes, words

MOST_BYTES = 48_000_000  # of text that a classifier is fitted on
MOST_TEXT = 1_000_000  # bytes of one text among them

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x30:0x3A] = ord("0")


def word_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): hashed 1- and 2-grams of lower-cased words and of word shapes, four a word; row r has
    buckets[first[r]:first[r + 1]]. A shape keeps the classes of characters with runs cut to one."""
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), first
    word = word_hashes(lower(data), starts, ends)
    kind = _CLASS[data]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = range_hash(mix(kind[keep].astype(U64) + U64(7)), at[starts], at[ends])
    previous_word, previous_shape = np.roll(word, 1), np.roll(shape, 1)
    heads = first[:-1][first[:-1] < first[1:]]
    previous_word[heads] = U64(1)
    previous_shape[heads] = U64(2)
    grams = np.stack([mix(word + U64(11)), mix(word + previous_word * U64(3)), mix(shape + U64(13)), mix(shape + previous_shape * U64(5))], axis=1)
    return (grams.ravel() >> U64(64 - bits)).astype(np.int64), first * 4


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, n: int, left_out: int, most_rows: int, most_bytes: int = MOST_BYTES, most_text: int = MOST_TEXT) -> DataFrame:
    """(text, target, luck): at most most_rows labelled rows outside the held-out fold, first by a hash of the id, of at most most_bytes of
    text together; texts of over most_text bytes are not among them, and rows repeated with id, text and label count once.

    What is chosen is bounded after labels and documents have met, so neither an id that many rows share nor long texts exceed the bounds. The broadcast
    sides of the joins have at most most_rows rows of 40 bytes.
    """
    chosen = labels.where(F.col(target).isNotNull() & (fold("doc_id", n) != left_out)).select("doc_id", F.col(target).cast("int").alias("target"), F.xxhash64("doc_id", F.lit("train")).alias("luck")).orderBy("luck", "target").limit(most_rows)
    size, key = F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    met = docs.select("doc_id", "text").where(size <= most_text).join(F.broadcast(chosen), "doc_id")
    order = ["luck", "target", "text_key"]
    few = met.select("doc_id", "target", "luck", key, size.cast("long").alias("size")).distinct().orderBy(*order).limit(most_rows)
    so_far = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over most_rows rows at most
    kept = cut(few.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).drop("size", "so_far"))
    rows = docs.select("doc_id", "text", key).where(size <= most_text).join(F.broadcast(kept), ["doc_id", "text_key"])
    return rows.dropDuplicates(["doc_id", "text_key", "target"]).select("text", "target", "luck")
