"""BAM files, read by ranges of bytes and sorted by coordinate. Records stay opaque bytes; only reference number and position are read from them."""

from __future__ import annotations

import gzip
import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators import order
from strandmill.sources import bgzf, blocks, ordered

MOST_RECORD = 1 << 28  # bytes of a record that a guess takes to be possible


def read_header(stream) -> tuple[str, bytes]:
    """(text, references): the header's text and its reference table as it stands."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    (size,) = struct.unpack("<i", stream.read(4))
    text = stream.read(size).rstrip(b"\0").decode()
    table = stream.read(4)
    for _ in range(struct.unpack("<i", table)[0]):
        name = stream.read(4)
        table += name + stream.read(struct.unpack("<i", name)[0] + 4)
    return text, table


def records(stream):
    """(tid, pos, record) of a stream past its header; a record without its leading size."""
    while head := stream.read(4):
        raw = stream.read(struct.unpack("<i", head)[0])
        tid, pos = struct.unpack_from("<ii", raw)
        yield tid, pos, raw


def _plausible(data: np.ndarray, references: int) -> np.ndarray:
    """Whether an alignment may begin at each byte: its numbers agree with one another and its name ends in a zero."""
    n = len(data) - 36
    if n <= 0:
        return np.zeros(0, bool)
    byte = [data[i : i + n].astype(np.int64) for i in range(36)]
    number = lambda i: (byte[i] | byte[i + 1] << 8 | byte[i + 2] << 16 | byte[i + 3] << 24) - (byte[i + 3] >> 7 << 32)
    size, name, bases = number(0), byte[12], number(20)
    ok = (size >= 32) & (size < MOST_RECORD) & (name > 0) & (bases >= 0)
    for reference, position in ((4, 8), (24, 28)):
        ok &= (number(reference) >= -1) & (number(reference) < references) & (number(position) >= -1)
    ok &= 32 + name + 4 * (byte[16] | byte[17] << 8) + (bases + 1) // 2 + bases <= size
    last = np.flatnonzero(ok)
    at = last + 36 + name[last] - 1
    ok[last] = data[np.minimum(at, len(data) - 1)] == 0
    return ok


def guessed(file: blocks.BlockFile, block: int, references: int) -> int | None:
    """The place in a block, or the ones after it, where a record seems to begin: a chain of plausible records leads from there to the end of the bytes looked at."""
    for data, begins, at, _ in file.stretches(block):
        ok = _plausible(np.frombuffer(data, np.uint8), references)
        for start in np.flatnonzero(ok).tolist():
            x = start
            while x < len(ok) and ok[x]:
                x += struct.unpack_from("<i", data, x)[0] + 4
            if x >= len(ok):
                b = int(np.searchsorted(begins, start, side="right")) - 1
                return int(at[b]) << 16 | (start - int(begins[b]))
        return None
    return None


def record_batches(file: blocks.BlockFile, begin: int, stop: int):
    """(places, bytes, starts, ends, next): the records, without their leading sizes, that begin at a place from begin to below stop, in stretches; next is
    where the record after them begins. A record begins at begin."""
    held, line_at, skip = b"", begin, begin & 0xFFFF
    for data, begins, at, following in file.stretches(begin >> 16):
        begins = begins - skip + len(held)
        data, skip = held + data[skip:], 0
        starts, x = [], 0
        while x + 4 <= len(data):
            end = x + 4 + struct.unpack_from("<i", data, x)[0]
            if end < x + 4 + 8:
                raise ValueError(f"no record begins at byte {x} behind block {int(at[0])}")
            if end > len(data):
                break
            starts.append(x)
            x = end
        edges = np.array([*starts, x], np.int64)
        block = np.searchsorted(begins, edges, side="right") - 1
        places = np.where(block >= 0, at[block] << 16 | (edges - begins[block]), line_at)
        if x == len(data):
            places[-1] = file.first_block(following) << 16
        own = int(np.searchsorted(places[:-1], stop))
        yield places[:own], data, edges[:own] + 4, edges[1 : own + 1], int(places[own])
        if places[own] >= stop:
            return
        held, line_at = data[x:], int(places[-1])
    if held:
        raise ValueError("the file ends within a record")


def record_ranges(spark: SparkSession, path: str, split: int = blocks.SPLIT) -> list[tuple[int, int]]:
    """(begin, stop): places between which each task's records begin.

    A record's bytes don't say where it begins, so each range guesses its first record and walks from there to the first record behind its end. The
    first range knows its beginning from the header. Where the walk of a range ends at the guess of the next one, that guess is right, as the range's own
    beginning is; where not, the range walks again from there. So the result rests on no guess.
    """
    bounds = blocks.ranges(path, split)
    header, references = header_end(path)

    def walk(file, k, begin):
        """(begin, stop, next) of a range; begin None: to be guessed."""
        first, stop = file.first_block(bounds[k]), file.first_block(bounds[k + 1])
        if k == 0:
            begin = header
        elif begin is None:
            begin = guessed(file, first, references) if first < stop else first << 16
        at = begin
        if begin is not None and begin < stop << 16:
            try:
                for *_, at in record_batches(file, begin, stop << 16):
                    pass
            except (ValueError, struct.error):
                at = None
        return k, begin, stop << 16, at

    def work(batches):
        with blocks.BlockFile(path) as file:
            for batch in batches:
                rows = [walk(file, k, told.get(k)) for k in batch.column("id").to_pylist()]
                yield pa.RecordBatch.from_pylist([dict(zip(("k", "begin", "stop", "next"), r, strict=True)) for r in rows], pa.schema([(c, pa.int64()) for c in ("k", "begin", "stop", "next")]))

    n, told = len(bounds) - 1, {}
    found = sorted(tuple(r) for r in spark.range(0, n, 1, n).mapInArrow(work, "k long, begin long, stop long, next long").collect())
    out, expected = [], None
    for k, begin, stop, following in found:
        if k and begin != expected:
            if expected is None:
                raise ValueError("the file holds no chain of records")
            told = {k: expected}
            ((_, begin, stop, following),) = spark.range(k, k + 1, 1, 1).mapInArrow(work, "k long, begin long, stop long, next long").collect()
        if following is None:  # a wrong guess is mended above; a right beginning that leads nowhere is damage
            raise ValueError(f"the records of range {k} are damaged")
        out.append((begin, stop))
        expected = following
    return out


def header_end(path: str) -> tuple[int, int]:
    """(the place of the first record, the number of references)."""
    with blocks.BlockFile(path) as file:
        held, need = b"", 0
        for data, begins, at, following in file.stretches(file.first_block(0)):
            begins = begins + len(held)
            held += data
            try:
                stream = io.BytesIO(held)
                text, table = read_header(stream)
                need = stream.tell()
            except (struct.error, IndexError):
                continue
            if need < len(held):
                b = int(np.searchsorted(begins, need, side="right")) - 1
                return (int(at[b]) << 16 | (need - int(begins[b]))), struct.unpack("<i", table[:4])[0]
            if need == len(held):
                return file.first_block(following) << 16, struct.unpack("<i", table[:4])[0]
    raise ValueError(f"{path} ends within its header")


def read_bam(spark: SparkSession, path: str, split: int = blocks.SPLIT) -> DataFrame:
    """input_ord, tid, pos, raw: the alignments by ranges of bytes, a task each. input_ord, the record's place, ascends in the file's order."""
    todo = record_ranges(spark, path, split)

    def work(batches):
        with blocks.BlockFile(path) as file:
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    if todo[k][0] < todo[k][1]:
                        for places, data, starts, ends, _ in record_batches(file, *todo[k]):
                            yield _alignments(places, data, starts, ends)

    return spark.range(0, len(todo), 1, len(todo)).mapInArrow(work, "input_ord long, tid int, pos int, raw binary")


def _alignments(places, data: bytes, starts, ends) -> pa.RecordBatch:
    raw = np.frombuffer(data, np.uint8)
    number = lambda at: raw[at[:, None] + np.arange(4)].reshape(-1).view("<i4")
    records_ = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(number(starts), pa.int32()), pa.array(number(starts + 4), pa.int32()), pa.array(records_, pa.binary())], ["input_ord", "tid", "pos", "raw"])


def sort_bam(alignments: DataFrame) -> DataFrame:
    return alignments.orderBy(*order.bam_keys(F.col("tid"), F.col("pos")), "input_ord")


def coordinate_header(text: str) -> str:
    """The header text with SO:coordinate in its first line."""
    lines = text.splitlines()
    if not lines or not lines[0].startswith("@HD"):
        return "\n".join(["@HD\tVN:1.6\tSO:coordinate", *lines]) + "\n"
    first = re.sub(r"\tSO:[^\t]*", "", lines[0])
    return "\n".join([f"{first}\tSO:coordinate", *lines[1:]]) + "\n"


def write_bam(alignments: DataFrame, source: str, path: str) -> None:
    """Ordered alignments under the header of the file they come from. Every task writes its part."""
    store, at = ordered.arrow_path(source)
    with store.open_input_stream(at, compression=None) as raw, gzip.open(raw) as stream:
        text, table = read_header(stream)

    def pack(batches, out):
        held = b""
        for batch in batches:
            held += b"".join(struct.pack("<i", len(raw)) + raw for raw in batch.column("raw").to_pylist())
            whole = len(held) - len(held) % bgzf.BLOCK
            out.write(bgzf.blocked(held[:whole]))
            held = held[whole:]
        out.write(bgzf.blocked(held))

    head = coordinate_header(text).encode()
    head = bgzf.blocked(b"BAM\1" + struct.pack("<i", len(head)) + head + table)
    ordered.assemble(alignments.sparkSession, ordered.written_parts(alignments.select("raw"), pack), head, bgzf.END_OF_FILE, path)
