"""Blocked gzip (BGZF) files read by byte ranges: blocks found from any byte, their stretches as lines.

A block is a gzip member of at most 64 kB that names its own size, so a range of bytes can be read by itself: a block belongs to the range in
which its first byte lies, a line or record to the range of the block in which it begins. A place is a virtual offset: the first byte of the block
in the file, shifted by 16 bits, plus the byte in the uncompressed block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from strandmill.sources import ordered

MAGIC = b"\x1f\x8b\x08\x04"  # fixed value of the format
MOST = 1 << 16  # bytes of a block
WINDOW = 1 << 20
SPLIT = 32 << 20  # compressed bytes of a task


class BlockFile:
    """Random access to the blocks of one file."""

    def __init__(self, path: str):
        store, at = ordered.arrow_path(path)
        self.file = store.open_input_file(at)
        self.size, self.base, self.held = self.file.size(), 0, b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def raw(self, at: int, n: int) -> bytes:
        """Up to n bytes from at on."""
        if not (self.base <= at and at + n <= self.base + len(self.held)):
            self.base, self.held = at, self.file.read_at(min(max(n, WINDOW), max(self.size - at, 0)), at)
        return self.held[at - self.base : at - self.base + n]

    def length(self, at: int) -> tuple[int, int] | None:
        """(bytes of the block that begins at `at`, bytes of its header), or None where none begins."""
        head = self.raw(at, 12)
        if len(head) < 12 or head[:4] != MAGIC:
            return None
        (extra,) = struct.unpack_from("<H", head, 10)
        fields, i = self.raw(at + 12, extra), 0
        while i + 4 <= len(fields):
            (n,) = struct.unpack_from("<H", fields, i + 2)
            if fields[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(fields):
                return struct.unpack_from("<H", fields, i + 4)[0] + 1, 12 + extra
            i += 4 + n
        return None

    def block(self, at: int) -> tuple[bytes, int]:
        """(its bytes, where the next begins). A block that is cut short or whose checksum differs ends the job."""
        found = self.length(at)
        if found is None:
            raise ValueError(f"no block begins at byte {at}")
        size, head = found
        raw = self.raw(at, size)
        if len(raw) < size:
            raise ValueError(f"the block at byte {at} is cut short")
        data = zlib.decompress(raw[head:-8], -15)
        if struct.unpack_from("<II", raw, size - 8) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at byte {at} is damaged")
        return data, at + size

    def _begins(self, at: int) -> bool:
        """Whether a whole block begins here: its name for its size, its checksum and its length agree."""
        try:
            _, end = self.block(at)
        except (ValueError, zlib.error, struct.error):
            return False
        return end == self.size or self.length(end) is not None

    def first_block(self, at: int) -> int:
        """Where the first block with bytes in it begins, from byte `at` on; the file's size if there is none."""
        while at < self.size:
            window = self.raw(at, 2 * MOST)
            i = window.find(MAGIC)
            while i >= 0 and not self._begins(at + i):
                i = window.find(MAGIC, i + 1)
            if i < 0:
                at += max(len(window) - len(MAGIC) + 1, 1)
                continue
            at += i
            while at < self.size:
                data, end = self.block(at)
                if data:
                    return at
                at = end
        return self.size

    def stretches(self, at: int):
        """(bytes, begins, blocks, next): about WINDOW uncompressed bytes at a time, where each block begins in them and in the file, from a block on."""
        while at < self.size:
            parts, begins, blocks, n = [], [], [], 0
            while at < self.size and n < WINDOW:
                data, end = self.block(at)
                if data:
                    parts.append(data)
                    begins.append(n)
                    blocks.append(at)
                    n += len(data)
                at = end
            if parts:
                yield b"".join(parts), np.array(begins), np.array(blocks), at


def is_blocked(path: str) -> bool:
    """Whether the file begins with a block; Python code must be able to open it, else False."""
    with BlockFile(path) as file:
        return file.length(0) is not None


def ranges(path: str, split: int = SPLIT) -> list[int]:
    """Byte bounds of the tasks that read a file."""
    with BlockFile(path) as file:
        return [*range(0, max(file.size, 1), split), file.size]


def line_batches(file: BlockFile, begin: int, stop: int, skip: bool):
    """(places, lines): the lines, as bytes without their ends, that begin at a place from begin to below stop. A line or a block begins at
    begin. skip: the line that is under way there belongs to another range."""
    held, line_at, at = b"", begin, begin & 0xFFFF  # the line under way: its bytes so far, its place, and where it goes on
    for data, begins, blocks, _ in file.stretches(begin >> 16):
        if line_at is None:
            line_at = int(blocks[0]) << 16
        ends = np.flatnonzero(np.frombuffer(data, np.uint8)[at:] == 10) + at
        if not len(ends):
            held, at = held + data[at:], 0
            continue
        lines = (held + data[at : ends[-1]]).split(b"\n")
        starts = ends + 1
        block = np.searchsorted(begins, starts, side="right") - 1
        place = blocks[block] << 16 | (starts - begins[block])
        places = np.concatenate([[line_at], place[:-1]])
        held, at = data[starts[-1] :], 0
        line_at = int(place[-1]) if held else None  # else the next line begins with the next block
        own = int(np.searchsorted(places, stop))
        yield places[skip:own], lines[skip:own]
        skip = False
        if own < len(places) or (line_at is not None and line_at >= stop):
            return
    if held and not skip and line_at < stop:
        yield np.array([line_at]), [held]


def range_lines(file: BlockFile, low: int, high: int):
    """The lines of a range of bytes: those that begin after the first byte of its first block, up to the first byte of the next range's."""
    begin, stop = file.first_block(low), file.first_block(high)
    if begin < stop:
        yield from line_batches(file, begin << 16, (stop << 16) + 1, low > 0)
