"""Blocked gzip (BGZF) text and the tabix index over it, both from their published specifications.

Reading: ranges of bytes are tasks, see blocks. Writing: every task compresses its lines to a part of the file and indexes it by places within the part;
the parts' sizes move the places, and the indexes are joined. The driver holds an index, which is by its design as large as the
genome is long and not as the file, and never a line.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import scalar
from strandmill.sources import blocks, ordered

# Fixed values of the two formats.
BLOCK = 65_280
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
TABIX_BED = 0x10000  # zero-based, half-open coordinates
LINEAR_SHIFT = 14
BIN_LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))


def block(data: bytes, level: int = 6) -> bytes:
    """One gzip member with its size in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(body) + 26
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def region_bin(low: int, high: int) -> int:
    """The smallest bin that holds [low, high)."""
    for shift, first in BIN_LEVELS:
        if low >> shift == (high - 1) >> shift:
            return first + (low >> shift)
    return 0


class TabixIndex:
    """Bins and 16 kb windows of every reference, over virtual offsets; lines come in order."""

    def __init__(self):
        self.names: list[str] = []
        self.bins: list[dict[int, list[list[int]]]] = []
        self.linear: list[list[int]] = []

    def add(self, chrom: str, low: int, high: int, begin: int, end: int) -> None:
        if not self.names or self.names[-1] != chrom:
            self.names.append(chrom)
            self.bins.append({})
            self.linear.append([])
        high = max(high, low + 1)
        chunks = self.bins[-1].setdefault(region_bin(low, high), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        windows = self.linear[-1]
        last = (high - 1) >> LINEAR_SHIFT
        while len(windows) <= last:
            windows.append(-1)
        for w in range(low >> LINEAR_SHIFT, last + 1):
            if windows[w] < 0:
                windows[w] = begin

    def append(self, other: TabixIndex, shift: int) -> None:
        """Takes over the index of the next part, whose places move by a number of bytes of the file."""
        move = shift << 16
        for name, bins, linear in zip(other.names, other.bins, other.linear, strict=True):
            if not self.names or self.names[-1] != name:
                self.names.append(name)
                self.bins.append({})
                self.linear.append([])
            for number, chunks in bins.items():
                have = self.bins[-1].setdefault(number, [])
                for begin, end in chunks:
                    if have and have[-1][1] == begin + move:
                        have[-1][1] = end + move
                    else:
                        have.append([begin + move, end + move])
            windows = self.linear[-1]
            windows.extend([-1] * (len(linear) - len(windows)))
            for w, at in enumerate(linear):
                if at >= 0 and windows[w] < 0:
                    windows[w] = at + move

    def to_bytes(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n in self.names)
        out = [b"TBI\1", struct.pack("<8i", len(self.names), TABIX_BED, 1, 2, 3, ord("#"), 0, len(names)), names]
        for bins, windows in zip(self.bins, self.linear, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            filled, before = [], 0
            for w in windows:
                before = w if w >= 0 else before
                filled.append(before)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        return b"".join(out)


class BlockWriter:
    """Compresses lines to blocks of a part as they come; a line stays in one block unless it is longer."""

    def __init__(self, out, index: TabixIndex | None = None):
        self.out, self.index, self.data, self.places = out, index, bytearray(), []

    def add(self, raw: bytes, *place) -> None:
        if self.data and len(self.data) + len(raw) > BLOCK:
            self.flush()
        if len(raw) <= BLOCK:
            self.places.append((*place, len(self.data), len(self.data) + len(raw)))
            self.data += raw
        else:
            at = self.out.tell()
            for i in range(0, len(raw), BLOCK):
                self.out.write(block(raw[i : i + BLOCK]))
            if self.index is not None:
                self.index.add(*place, at << 16, self.out.tell() << 16)

    def flush(self) -> None:
        if not self.data:
            return
        at, size = self.out.tell(), len(self.data)
        self.out.write(block(bytes(self.data)))
        if self.index is not None:
            for chrom, low, high, begin, end in self.places:
                self.index.add(chrom, low, high, at << 16 | begin, self.out.tell() << 16 if end == size else at << 16 | end)
        self.data, self.places = bytearray(), []


def blocked(raw: bytes) -> bytes:
    return b"".join(block(raw[i : i + BLOCK]) for i in range(0, len(raw), BLOCK))


def write(records: DataFrame, path: str, header: list[str] = (), tabix: bool = False) -> None:
    """Ordered records (value, chrom, start, end) as path, and path + .tbi. Every task writes and indexes its part."""

    def pack(batches, out):
        index = TabixIndex() if tabix else None
        writer = BlockWriter(out, index)
        for batch in batches:
            for line, *place in zip(*(batch.column(c).to_pylist() for c in ("value", "chrom", "start", "end")), strict=True):
                writer.add(line.encode() + b"\n", *place)
        writer.flush()
        return index and (index.names, index.bins, index.linear)

    parts = ordered.written_parts(records.select("value", "chrom", "start", "end"), pack)
    head = blocked("".join(f"{h}\n" for h in header).encode())
    ordered.assemble(records.sparkSession, parts, head, END_OF_FILE, path)
    if tabix:
        index = TabixIndex()
        for (_, _, told), begin in zip(parts, ordered.places(parts, head), strict=True):
            own = TabixIndex()
            own.names, own.bins, own.linear = told
            index.append(own, begin)
        with ordered.atomic(f"{path}.tbi") as out:
            out.write(blocked(index.to_bytes()) + END_OF_FILE)


def _lines(spark: SparkSession, path: str, n: int, of) -> DataFrame:
    """line_id (the place), value: the lines that of(file, k) gives, for k from 0 to n - 1, a task each."""

    def work(batches):
        with blocks.BlockFile(path) as file:
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    for places, lines in of(file, k):
                        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], ["line_id", "value"])

    return spark.range(0, n, 1, n).mapInArrow(work, "line_id long, value string")


def read_lines(spark: SparkSession, path: str, split: int = blocks.SPLIT) -> DataFrame:
    """value, line_id: the lines of a blocked file by ranges of bytes, a carriage return at their end removed. Ids ascend in the file's order."""
    bounds = blocks.ranges(path, split)
    read = _lines(spark, path, len(bounds) - 1, lambda file, k: blocks.range_lines(file, bounds[k], bounds[k + 1]))
    return read.select(scalar.without_return(F.col("value")).alias("value"), "line_id")


def index_chunks(path: str, chrom: str, low: int, high: int) -> list[tuple[int, int]]:
    """Stretches of places, apart and in order, that hold all lines of a region, by the .tbi beside the file."""
    store, at = ordered.arrow_path(f"{path}.tbi")
    with store.open_input_stream(at, compression=None) as stream:
        raw = gzip.decompress(stream.read())
    n, _, _, _, _, _, _, size = struct.unpack_from("<8i", raw, 4)
    names = raw[36 : 36 + size].split(b"\0")[:n]
    at = 36 + size
    levels = [range(first + (low >> shift), first + ((high - 1) >> shift) + 1) for shift, first in BIN_LEVELS]
    for name in names:
        (n_bins,) = struct.unpack_from("<i", raw, at)
        at += 4
        chunks = []
        for _ in range(n_bins):
            number, count = struct.unpack_from("<Ii", raw, at)
            if number == 0 or any(number in level for level in levels):
                chunks += np.frombuffer(raw, "<u8", 2 * count, at + 8).reshape(-1, 2).tolist()
            at += 8 + 16 * count
        (n_windows,) = struct.unpack_from("<i", raw, at)
        windows = np.frombuffer(raw, "<u8", n_windows, at + 4)
        at += 4 + 8 * n_windows
        if name.decode() == chrom:
            floor = int(windows[min(low >> LINEAR_SHIFT, n_windows - 1)]) if n_windows else 0
            found = []
            for begin, end in sorted((max(a, floor), b) for a, b in chunks if b > floor):
                if found and begin <= found[-1][1]:
                    found[-1][1] = max(end, found[-1][1])
                else:
                    found.append([begin, end])
            return [(a, b) for a, b in found]
    return []


def fetch(spark: SparkSession, path: str, chrom: str, low: int, high: int) -> DataFrame:
    """value, line_id: the lines of a tabix-indexed file that overlap the region. Only the blocks that the index names are read, stretches of about a
    split's bytes a task."""
    tasks, size = [[]], 0
    for begin, end in index_chunks(path, chrom, low, max(high, low + 1)):
        if tasks[-1] and size > blocks.SPLIT:
            tasks.append([])
            size = 0
        tasks[-1].append((begin, end))
        size += (end >> 16) - (begin >> 16)

    def of(file, k):
        for begin, end in tasks[k]:
            yield from blocks.line_batches(file, begin, end, False)

    field = lambda i: F.get(F.split("value", "[\t ]", i + 3), F.lit(i))
    near = (field(0) == chrom) & (field(1).cast("long") < high) & (field(2).cast("long") > low)
    return _lines(spark, path, len(tasks), of).where(near)
