"""Exact removal of repeated word windows behind a count-min prefilter.

A window is `width` consecutive words of one document. Every word covered by a window whose word sequence also starts
somewhere else is removed, all occurrences alike, judged on the input.

Texts are dealt once into blocks of about BLOCK bytes. Pass 1: each block hashes all windows of its whole texts into a count-min
sketch of ROWS rows, whose cells grow with the input, and ships the cells that it touches, under two bytes each, to the slices
of the sketch. A slice merges the blocks' cells by addition and answers each block with one bit a cell: touched twice or more.
Pass 2: windows whose every cell was touched twice are candidates; a window that repeats always is. A block ships the 96-bit
hashes of its candidates, equal ones joined beforehand, so a window common to a third of all documents is one entry a block.
Targets group them by hash, exactly, and answer with one bit a candidate. Pass 3: blocks drop the covered words. Slices,
targets and blocks hold a bounded share each, whatever the input's size; nothing is broadcast or collected.

Defined cases: a null or short text has no window and stays as it is; rows repeated with the same id and text repeat
each other's windows; a null id is an id; an empty table gives an empty result; extra columns pass through `remove`, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.llm.textkit import U64

ROWS = 2
SLICE_BITS = 24  # a slice has at most 2**SLICE_BITS cells
LEAST_SLICES_BITS = 5
LEAST_BITS = 12  # of all cells; above, there is a cell in a sketch row for each byte of text or two, whatever the input
CELLS_A_BYTE = 1.0
BLOCK = 4_000_000  # bytes of text
TARGET = 8_000_000  # bytes of text whose windows one target groups
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_SECOND = 0xD6E8FEB86659FD93


def window_hashes(word: np.ndarray, first: np.ndarray, width: int):
    """(h1, h2, count): 64 and 32 bits of the hash of every window in order, and the windows of each row, from word hashes."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1], count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
    h1 = textkit.range_hash(word, begin, begin + width)
    h2 = textkit.range_hash(textkit.mix(word ^ U64(_SECOND)), begin, begin + width, _SECOND)
    return h1, (h2 >> U64(32)).astype(np.uint32), count


class Block:
    """The texts of a block in the order of their keys, their words and windows. Rows of equal keys are equal."""

    def __init__(self, table: pa.Table, width: int):
        data, offsets = textkit.byte_view(table.column("text"))
        self.order = np.lexsort((np.diff(offsets), table.column("row_key").to_numpy()))
        self.texts = table.column("text").take(pa.array(self.order))
        self.width, self.pieces, found = width, [], [(np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for a, b, data, offsets in textkit.pieces(self.texts):
            starts, ends, first = textkit.words(data, offsets)
            self.pieces.append((a, b, data, offsets, starts, ends, first))
            found.append(window_hashes(textkit.word_hashes(data, starts, ends), first, width))
        self.h1, self.h2, self.count = (np.concatenate(x) for x in zip(*found, strict=True))

    def covered(self, windows: np.ndarray):
        """(a, b, data, offsets, starts, ends, first, gone) of each stretch of rows: whether each word lies in one of the windows."""
        before = np.cumsum(self.count) - self.count
        for a, b, data, offsets, starts, ends, first in self.pieces:
            low, high = np.searchsorted(windows, (before[a], before[b - 1] + self.count[b - 1]))
            own = windows[low:high]
            row = np.searchsorted(before[a:b], own, side="right") - 1
            begin = first[row] + own - before[a + row]
            cover = np.bincount(begin, minlength=len(starts) + 1) - np.bincount(begin + self.width, minlength=len(starts) + 1)
            yield a, b, data, offsets, starts, ends, first, np.cumsum(cover[: len(starts)]) > 0


def _share(h: np.ndarray, n: int) -> np.ndarray:
    """The part, of n equal ranges, that the upper 32 bits of an unsigned 64-bit hash fall in."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


class Sketch:
    """The layout of the count-min sketch: cells in slices."""

    def __init__(self, size: int):
        self.bits = max(LEAST_BITS, int(size * CELLS_A_BYTE).bit_length())
        self.slice_bits = min(SLICE_BITS, self.bits - LEAST_SLICES_BITS)
        self.slices = 1 << (self.bits - self.slice_bits)

    def cells(self, h1: np.ndarray, row: int) -> np.ndarray:
        return (h1 * _ODD[row]) >> U64(64 - self.bits)

    def edges(self, distinct: np.ndarray) -> np.ndarray:
        """Where the slices begin in ascending cells, and their end."""
        return np.append(np.searchsorted(distinct, np.arange(self.slices, dtype=U64) << U64(self.slice_bits)), len(distinct))


def _grouped(a: np.ndarray, b: np.ndarray):
    """(order, alone, several): the order of the hashes; the places in that order of those met once; the first places of those met more often."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    many = np.diff(np.append(head, len(a))) > 1
    return order, head[~many], head[many]


def _table(rows: list[tuple], **kinds) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def dealt(docs: DataFrame, size: int) -> DataFrame:
    """row, text, row_key, block. Rows repeated with id and text are dealt by their partition too, so that they make no hot block."""
    key = F.xxhash64("doc_id", "text")
    blocks = max(textkit.partitions(docs.sparkSession), -(-size // BLOCK))
    return textkit.sealed(docs, row_key=key, block=F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(blocks)).cast("int"))


def answers(blocked: DataFrame, size: int, width: int) -> DataFrame:
    """block, target, bits, mask: for each block the candidates among its windows (mask, one row) and which of each target's repeat (bits)."""
    sketch, targets = Sketch(size), max(textkit.partitions(blocked.sparkSession), -(-size // TARGET))

    def touch(table):
        block, h1, rows = table.column("block")[0].as_py(), Block(table, width).h1, []
        for row in range(ROWS):
            cells = textkit.distinct(sketch.cells(h1, row))
            edges = sketch.edges(cells)
            for s in np.flatnonzero(np.diff(edges)):
                own = cells[edges[s] : edges[s + 1]] & U64((1 << sketch.slice_bits) - 1)
                rows.append((row * sketch.slices + int(s), block, textkit.ascending_packed(own, 1 << sketch.slice_bits)))
        return _table(rows, slice=pa.int32(), block=pa.int32(), cells=pa.binary())

    def merge(table):
        once, twice = (np.zeros(1 << sketch.slice_bits, bool) for _ in range(2))
        blobs = table.column("cells").to_pylist()
        for blob in blobs:
            cells = textkit.ascending_read(blob)
            twice[cells] |= once[cells]
            once[cells] = True
        bits = [np.packbits(twice[textkit.ascending_read(blob)]).tobytes() for blob in blobs]
        return pa.table({"slice": table.column("slice"), "block": table.column("block"), "bits": pa.array(bits, pa.binary())})

    def candidates(table, merged):
        """A row for each target: the hashes met once here, then those met more often; and a row with the mask."""
        if not table.num_rows:
            return _table([], target=pa.int32(), block=pa.int32(), h1=pa.binary(), h2=pa.binary(), alone=pa.int32(), mask=pa.binary())
        block, own = table.column("block")[0].as_py(), Block(table, width)
        of = dict(zip(merged.column("slice").to_pylist(), merged.column("bits").to_pylist(), strict=True))
        may = np.ones(len(own.h1), bool)
        for row in range(ROWS):
            cells = sketch.cells(own.h1, row)
            ascending = np.sort(cells)
            head = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, np.int64)
            distinct, twice = ascending[head], np.diff(np.append(head, len(ascending))) > 1
            edges = sketch.edges(distinct)
            for s in np.flatnonzero(np.diff(edges)):
                twice[edges[s] : edges[s + 1]] |= _bits(of[row * sketch.slices + int(s)], int(edges[s + 1] - edges[s]))
            left = np.flatnonzero(may)
            may[left] = twice[np.searchsorted(distinct, cells[left])]
        a, b = own.h1[may], own.h2[may]
        order, alone, several = _grouped(a, b)
        a, b = a[order], b[order]
        rows = [(block % targets, block, None, None, 0, np.packbits(may).tobytes())]
        cuts = [np.searchsorted(_share(a[x], targets), np.arange(targets + 1)) for x in (alone, several)]
        for t in np.flatnonzero(np.diff(cuts[0]) + np.diff(cuts[1])):
            at = np.concatenate([x[c[t] : c[t + 1]] for x, c in zip((alone, several), cuts, strict=True)])
            rows.append((int(t), block, a[at].tobytes(), b[at].tobytes(), int(cuts[0][t + 1] - cuts[0][t]), None))
        return _table(rows, target=pa.int32(), block=pa.int32(), h1=pa.binary(), h2=pa.binary(), alone=pa.int32(), mask=pa.binary())

    def settle(table):
        """Groups a target's candidates by hash: those of two blocks, or met more often in one, repeat."""
        blocks, alone, masks = (table.column(c).to_pylist() for c in ("block", "alone", "mask"))
        h1 = [np.frombuffer(x or b"", U64) for x in table.column("h1").to_pylist()]
        h2 = [np.frombuffer(x or b"", np.uint32) for x in table.column("h2").to_pylist()]
        size = np.array([len(x) for x in h1])
        begin = np.cumsum(size) - size
        weight = np.full(int(size.sum()), 2, np.int8)
        for x, n in zip(begin.tolist(), alone, strict=True):
            weight[x : x + n] = 1
        a, b = np.concatenate(h1), np.concatenate(h2)
        del h1, h2
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        group = np.cumsum(new) - 1
        repeats = np.zeros(len(a), bool)
        repeats[order] = (np.bincount(group, weight[order]) >= 2)[group] if len(a) else False
        t = table.column("target")[0].as_py()
        rows = [(block, t, None if mask is not None else np.packbits(repeats[x : x + n]).tobytes(), mask) for block, mask, x, n in zip(blocks, masks, begin.tolist(), alone, strict=True)]
        return _table(rows, block=pa.int32(), target=pa.int32(), bits=pa.binary(), mask=pa.binary())

    merged = blocked.groupBy("block").applyInArrow(touch, "slice int, block int, cells binary").groupBy("slice").applyInArrow(merge, "slice int, block int, bits binary")
    found = blocked.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(candidates, "target int, block int, h1 binary, h2 binary, alone int, mask binary")
    return found.groupBy("target").applyInArrow(settle, "block int, target int, bits binary, mask binary")


def applied(docs: DataFrame, width: int, out, schema) -> DataFrame:
    """out(table, block, covered stretches) for each block of the documents, as one DataFrame of the schema."""
    size = textkit.text_bytes(docs)
    blocked = dealt(docs, size)
    targets = max(textkit.partitions(docs.sparkSession), -(-size // TARGET))

    def drop(table, told):
        block = Block(table, width)
        of, mask = {}, b""
        for target, bits, own in zip(*(told.column(c).to_pylist() for c in ("target", "bits", "mask")), strict=True):
            if own is not None:
                mask = own
            else:
                of[target] = bits
        may = np.flatnonzero(_bits(mask, len(block.h1)))
        a, b = block.h1[may], block.h2[may]
        order, alone, _ = _grouped(a, b)
        repeats = np.ones(len(may), bool)
        cuts = np.searchsorted(_share(a[order[alone]], targets), np.arange(targets + 1))
        for t in np.flatnonzero(np.diff(cuts)):
            repeats[order[alone[cuts[t] : cuts[t + 1]]]] = _bits(of[int(t)], int(cuts[t + 1] - cuts[t]))
        return out(table.take(pa.array(block.order)), block.covered(may[repeats]))

    told = answers(blocked, size, width)
    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(drop, schema)


def report(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for every document."""

    def out(table, stretches):
        n_words, n_removed, digests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for _, _, data, _, starts, ends, first, gone in stretches:
            before = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(np.diff(first))
            n_removed.append(before[first[1:]] - before[first[:-1]])
            kept = np.flatnonzero(~gone)
            raw, begins, stops = textkit.joined(data, starts[kept], ends[kept])
            low = np.searchsorted(kept, first).tolist()
            digests += [hashlib.sha256(raw[begins[a] : stops[b - 1]] if b > a else b"").hexdigest() for a, b in zip(low[:-1], low[1:], strict=True)]
        return pa.table({"doc_id": table.column("row").combine_chunks().field(0), "n_words": np.concatenate(n_words), "n_removed": np.concatenate(n_removed), "kept_sha256": pa.array(digests, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return applied(docs.select("doc_id", "text"), width, out, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, width: int) -> DataFrame:
    """docs, with the repeated passages cut out of text. White space around kept words stays, texts without repeats stay
    byte for byte, n_chars (where there is one) follows the text."""

    def out(table, stretches):
        texts = table.column("text").to_pylist()
        for a, _, data, offsets, starts, ends, first, gone in stretches:
            before = np.concatenate([[0], np.cumsum(gone)])
            for r in np.flatnonzero(before[first[1:]] > before[first[:-1]]):
                own = slice(first[r], first[r + 1])
                begin, n = starts[own], int(first[r + 1] - first[r])
                edge = np.flatnonzero(np.diff(gone[own].astype(np.int8), prepend=0, append=0))
                pieces, at = [], int(offsets[r])
                for i, j in zip(edge[::2], edge[1::2], strict=True):
                    pieces.append(data[at : begin[i]].tobytes())
                    at = int(begin[j]) if j < n else int(offsets[r + 1])
                texts[a + r] = b"".join([*pieces, data[at : offsets[r + 1]].tobytes()]).decode("utf-8")
        return pa.table({"row": table.column("row"), "text": pa.array(texts, pa.string())})

    sealed = textkit.sealed(docs)
    cleaned = textkit.unsealed(applied(docs, width, out, sealed.schema), docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
