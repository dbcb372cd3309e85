"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut further after every word whose hash is 0 modulo CUT, so a text of one line has cells too and
an edit moves only the cuts around it. A paragraph's digest is 64 bits of its bytes and its occurrence number. A sketch
has three thirds of cells (count, xor of digests, xor of checks); a digest enters one cell of each third. The sketches of
two versions subtract cell by cell, and peeling cells that hold one digest recovers the digests in which they differ.
The fingerprint is the smallest sketch; where peeling stalls, both versions are sketched again with four times the cells,
until it succeeds: a sketch of more cells than digests peels but for a vanishing chance, and the next is larger again.

The next document is found by ranging on doc_id: the first row of each range is also sent to the range before it, and
each task streams through its sorted rows holding one text over. Bounds come from an approximate quantile of the ids, the
first ids of the ranges are one number a range, and there are at most MOST_RANGES of them.

Defined cases: a null text is empty; texts without words have equal, empty fingerprints and likeness 1; a null doc_id
counts as the least; equal ids are ordered by their text; one document is its own next; an empty table gives an empty result;
columns other than doc_id and text are not read; ids are integers, and an id that is none ends the job.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.llm.textkit import U64, mix

CELLS = 18
CUT = 4
TABLE_CELLS = 1_500_000  # cells of all sketches that a task builds at once
CHUNK_BYTES = 2_000_000
MOST_RANGES = 16_384  # of ids, whose bounds are literals of the plan; a task streams through its range, however long
_SEEDS = np.array([0x8CB92BA72F3D8DD7, 0xD1342543DE82EF95, 0xAEF17502108EF2D9], dtype=np.uint64)
_CHECK = U64(0xF1357AEA2E62A9C5)


def paragraph_digests(data: np.ndarray, offsets: np.ndarray):
    """(digests, first): the digests of each row's paragraphs, distinct within the row."""
    starts, ends, first = textkit.words(data, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    word = textkit.word_hashes(data, starts, ends)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = word % U64(CUT) == 0
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    close = np.flatnonzero(last)
    begin = np.concatenate([[0], close[:-1] + 1])
    row = np.searchsorted(first, begin, side="right") - 1
    digest = textkit.range_hash(textkit._BYTE_CODE[data], starts[begin], ends[close])
    order = np.lexsort((digest, row))
    row, digest = row[order], digest[order]
    new = np.concatenate([[True], (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(new)
    occurrence = np.arange(len(digest)) - np.repeat(at, np.diff(np.append(at, len(digest))))
    return mix(digest + occurrence.astype(U64) * U64(0x9FB21C651E98DF25)), np.searchsorted(row, np.arange(len(offsets)))


def check(digest: np.ndarray) -> np.ndarray:
    return mix(digest ^ _CHECK) >> U64(32)


def places(digest: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each of the three thirds, as rows of three."""
    third = U64(cells // 3)
    return np.stack([(((mix(digest * s) >> U64(32)) * third) >> U64(32)).astype(np.int64) + i * (cells // 3) for i, s in enumerate(_SEEDS)], axis=1)


class Sketches:
    """The sketches of many texts: flat arrays of rows * cells."""

    def __init__(self, digests: np.ndarray, first: np.ndarray, cells: int):
        rows = len(first) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        at = (places(digests, cells) + (row * cells)[:, None]).ravel()
        self.cells, self.rows = cells, rows
        self.count = np.bincount(at, minlength=rows * cells)
        self.key, self.check = np.zeros(rows * cells, U64), np.zeros(rows * cells, U64)
        if len(at):
            order = np.argsort(at, kind="stable")
            head = np.flatnonzero(np.diff(at[order], prepend=-1))
            self.key[at[order[head]]] = np.bitwise_xor.reduceat(digests[order // 3], head)
            self.check[at[order[head]]] = np.bitwise_xor.reduceat(check(digests)[order // 3], head)

    def text(self, sizes: np.ndarray) -> list[str]:
        """The fingerprints: the number of digests and the cells, in base64."""
        out = np.zeros((self.rows, 4 + self.cells * 14), np.uint8)
        out[:, :4] = sizes.astype("<u4").view(np.uint8).reshape(-1, 4)
        c = self.rows, self.cells
        out[:, 4:].reshape(*c, 14)[:, :, :2] = (self.count & 0xFFFF).astype("<u2").view(np.uint8).reshape(*c, 2)
        out[:, 4:].reshape(*c, 14)[:, :, 2:10] = self.key.view(np.uint8).reshape(*c, 8)
        out[:, 4:].reshape(*c, 14)[:, :, 10:] = self.check.astype("<u4").view(np.uint8).reshape(*c, 4)
        return [base64.b64encode(x.tobytes()).decode() for x in out]


def peel(count: np.ndarray, key: np.ndarray, sum_: np.ndarray, cells: int):
    """(done, row, digest, sign): which rows peeled to nothing, and the recovered digests: sign 1 in the first version only, -1 in the
    second only. The arrays are differences of sketches and are used up. A row gives at most as many digests as it has cells: a cell
    whose check fits by chance would be taken out and put back for ever."""
    rows = len(count) // cells
    found, given = [], np.zeros(rows, np.int64)
    look = np.flatnonzero(np.abs(count) == 1)
    while True:
        pure = look[(np.abs(count[look]) == 1) & (sum_[look] == check(key[look]))]
        if not len(pure):
            break
        row, digest, sign = pure // cells, key[pure], count[pure]
        order = np.lexsort((digest, row))
        new = np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(digest[order]) != 0)])
        own = order[new]
        row, digest, sign = row[own], digest[own], sign[own]
        given += np.bincount(row, minlength=rows)
        own = given[row] <= cells
        row, digest, sign = row[own], digest[own], sign[own]
        found.append((row, digest, sign))
        at = places(digest, cells) + (row * cells)[:, None]
        flat = at.ravel()
        np.subtract.at(count, flat, np.repeat(sign, 3))
        np.bitwise_xor.at(key, flat, np.repeat(digest, 3))
        np.bitwise_xor.at(sum_, flat, np.repeat(check(digest), 3))
        look = np.unique(flat)
    done = ~((count != 0) | (key != 0)).reshape(rows, cells).any(axis=1) & (given <= cells)
    return done, *(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))


def _rows_of(digests, first, rows):
    """The digests of some rows, as (digests, first)."""
    size = np.diff(first)[rows]
    at = np.concatenate([[0], np.cumsum(size)])
    return digests[np.repeat(first[rows], size) + np.arange(at[-1]) - np.repeat(at[:-1], size)], at


def differences(a, b, cells: int = CELLS) -> np.ndarray:
    """The number of digests in exactly one of the two versions, for each row of a and b, which are (digests, first)."""
    n = len(a[1]) - 1
    out = np.zeros(n, np.int64)
    left = np.arange(n)
    while len(left):
        stalled = []
        step = max(1, TABLE_CELLS // cells)
        for i in range(0, len(left), step):
            rows = left[i : i + step]
            x, y = Sketches(*_rows_of(*a, rows), cells), Sketches(*_rows_of(*b, rows), cells)
            done, row, _, _ = peel(x.count - y.count, x.key ^ y.key, x.check ^ y.check, cells)
            out[rows] = np.where(done, np.bincount(row, minlength=len(rows)), 0)
            stalled.append(rows[~done])
        left = np.concatenate(stalled)
        cells *= 4
    return out


def likeness(sizes_a: np.ndarray, sizes_b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Shared over all digests, from the sizes and the number of differing ones; 1 for two empty texts."""
    shared = (sizes_a + sizes_b - apart) / 2
    every = sizes_a + sizes_b - shared
    return np.where(every > 0, shared / np.maximum(every, 1), 1.0)


def _digests(texts: list[str]):
    column = pa.array(texts, pa.large_string())
    parts = [paragraph_digests(data, offsets) for _, _, data, offsets in textkit.pieces(column)]
    digests = np.concatenate([d for d, _ in parts]) if parts else np.zeros(0, U64)
    base = np.cumsum([0, *(len(d) for d, _ in parts)])
    first = np.concatenate([*(f[:-1] + s for (_, f), s in zip(parts, base, strict=False)), [len(digests)]]).astype(np.int64)
    return digests, first


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compared(ids, texts: list[str]) -> pa.RecordBatch:
    """The result rows of all texts but the last, each with the one after it."""
    own, following = texts[:-1], texts[1:]
    changed = [edited(a, b) for a, b in zip(own, following, strict=True)]
    a, e = _digests(texts), _digests(changed)
    sizes, sizes_e = np.diff(a[1]), np.diff(e[1])
    before = (a[0][: a[1][-2]], a[1][:-1])
    after = (a[0], a[1][1:])
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(Sketches(*before, CELLS).text(sizes[:-1])),
            pa.array(Sketches(*e, CELLS).text(sizes_e)),
            pa.array(likeness(sizes[:-1], sizes_e, differences(before, e))),
            pa.array(likeness(sizes[:-1], sizes[1:], differences(before, after))),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, range, own: the documents sorted within ranges of doc_id, each range followed by the first document after it (own false)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"))
    cuts = sorted({int(b) for b in docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    numbered = base.withColumn("range", textkit.range_of(F.col("place"), cuts).cast("int"))
    firsts = numbered.groupBy("range").agg(F.min("place").alias("place")).orderBy("range").collect()
    # The first document of a range, the least text among equal ids, also follows the range before; the very first follows the last.
    follows = [(r["place"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)]
    sent = F.broadcast(docs.sparkSession.createDataFrame(follows, "place long, before int"))
    heads = numbered.join(sent, "place").groupBy("place", "before").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    follow = heads.select("doc_id", "text", "place", F.col("before").alias("range"), F.lit(False).alias("own"))
    rows = numbered.select("doc_id", "text", "place", "range", F.lit(True).alias("own")).union(follow)
    return rows.repartition(ranges, "range").sortWithinPartitions("range", F.desc("own"), "place", "text").select("doc_id", "text", "range", "own")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    kind = docs.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(textkit.partitions(docs.sparkSession), size // 16_000_000))

    def apply(batches):
        held_ids, held, at, size = [], [], None, 0

        def out(ids, texts):
            return _compared(pa.array(ids, pa.int64()), texts)

        for batch in batches:
            for doc_id, text, number, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "own")), strict=True):
                if not own:  # what follows the range
                    yield out(held_ids, [*held, text])
                    held_ids, held, at, size = [], [], None, 0
                    continue
                if size > CHUNK_BYTES and held:
                    yield out(held_ids, [*held, text])
                    held_ids, held, size = [], [], 0
                held_ids.append(doc_id)
                held.append(text)
                at = number
                size += len(text)
        assert at is None, "a range without a following document"

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = with_next(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ranges)
    return rows.mapInArrow(apply, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
