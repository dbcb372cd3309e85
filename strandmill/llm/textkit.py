"""Shared numpy routines over Arrow string columns: byte views, words, hashes, blobs, shared storage.

A text is handled as its UTF-8 bytes. Words are runs of bytes outside space and 0x09-0x0D, which are single bytes in
UTF-8, so splitting bytes and splitting characters agree. A null text counts as empty everywhere in this subpackage.
"""

from __future__ import annotations

import contextlib
import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandmill.plans.storage import cut, small  # noqa: F401

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

# Arrays of over 8 MB, which a stretch of texts doesn't need, go back to the system when freed, so that workers that live through
# many stages stay small; smaller ones are used again.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL("libc.so.6").mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
    ctypes.CDLL("libc.so.6").mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
pa.set_memory_pool(pa.system_memory_pool())
_BYTE_CODE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def partitions(spark, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


ROW_KEYS = ["row_key", "row_key2"]


def row_keys(*columns):
    """128 bits that stand for a row's columns: equal rows have equal keys, and others never in practice."""
    return dict(zip(ROW_KEYS, (F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)), strict=True))


def text_bytes(docs, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def named(name: str):
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def sealed(docs, opened=("text",), **own):
    """docs as row, the opened columns and own ones: all other columns lie in the struct row, where no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in opened]
    row = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.struct(F.lit(0).alias("c"))
    return docs.select(row.alias("row"), *opened, *[c.alias(n) for n, c in own.items()])


def unsealed(df, columns: list[str], opened=("text",), *more):
    """The columns that sealed() packed, in their order, and more, from df with row and the opened ones."""
    rest = {c: f"c{i}" for i, c in enumerate(c for c in columns if c not in opened)}
    return df.select(*[F.col(c) if c in opened else F.col("row")[rest[c]].alias(c) for c in columns], *more)


def range_of(key, bounds: list[int]):
    """A column: the number of bounds below the key, by two searches of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(2, math.isqrt(len(bounds)))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(longs(bounds[step - 1 :: step]), lambda b: b < key)) if len(bounds) >= step else F.lit(0)
    return coarse * step + F.size(F.filter(F.slice(longs(bounds), coarse * step + 1, step), lambda b: b < key))


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def spans(offsets: np.ndarray, most_bytes: int):
    """Row ranges [a, b) of at most most_bytes bytes each, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def pieces(column, most_bytes: int = 500_000):
    """(a, b, bytes, offsets) for stretches of rows of the column; the bytes and offsets are the stretch's own."""
    data, offsets = byte_view(column)
    for a, b in spans(offsets, most_bytes):
        own = offsets[a : b + 1]
        yield a, b, data[own[0] : own[-1]], own - own[0]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and for each row (and one past the last) its first word."""
    inside = ~_SPACE[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's life and grown when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16) * 5 // 4, base, dtype=U64)
        grown[0] = 1
        have = _powers[base] = np.multiply.accumulate(grown)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each range: polynomial prefix sums modulo 2**64, then mixed."""
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values), base), out=total[1:])
    inverse = _INVERSE if base == _BASE else pow(base, -1, 1 << 64)
    return mix((total[ends] - total[starts]) * powers(len(values) + 1, inverse)[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(_BYTE_CODE[data], starts, ends)


_P = [U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # fixed values of XXH64


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << U64(by) | h >> U64(64 - by)


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[s:e] for each range, by its public specification: all ranges advance together, each as far as its length goes."""
    p1, p2, p3, p4, p5 = _P
    first = np.array([seed], U64)  # arrays wrap around in silence
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    step = lambda acc, at: _turned(acc + eight[at] * p2, 31) * p1
    size, at = ends - starts, starts.astype(np.int64)
    h = np.repeat(first + p5, len(starts))
    rows = np.flatnonzero(size >= 32)
    if len(rows):
        n = len(rows)
        lanes = [np.repeat(x, n) for x in (first + p1 + p2, first + p2, first, first - p1)]
        live = np.arange(n)
        while len(live):
            own = rows[live]
            for j, lane in enumerate(lanes):
                lane[live] = step(lane[live], at[own] + 8 * j)
            at[own] += 32
            live = live[ends[own] - at[own] >= 32]
        found = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for lane in lanes:
            found = (found ^ (_turned(lane * p2, 31) * p1)) * p1 + p4
        h[rows] = found
    h += size.astype(U64)
    rows = np.flatnonzero(ends - at >= 8)
    while len(rows):
        h[rows] = _turned(h[rows] ^ (_turned(eight[at[rows]] * p2, 31) * p1), 27) * p1 + p4
        at[rows] += 8
        rows = rows[ends[rows] - at[rows] >= 8]
    rows = np.flatnonzero(ends - at >= 4)
    h[rows] = _turned(h[rows] ^ (four[at[rows]].astype(U64) * p1), 23) * p2 + p3
    at[rows] += 4
    rows = np.flatnonzero(ends > at)
    while len(rows):
        h[rows] = _turned(h[rows] ^ (data[at[rows]].astype(U64) * p5), 11) * p1
        at[rows] += 1
        rows = rows[ends[rows] > at[rows]]
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return h ^ (h >> U64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by sorting, which is faster here than np.unique's table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, begins, stops): the byte ranges one after the other with a space between, and where each lies."""
    size = ends - starts
    begins = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[inside + np.repeat(begins, size)] = data[inside + np.repeat(starts, size)]
    return out.tobytes(), begins, begins + size


def without(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, gone: np.ndarray) -> str:
    """The text of a row, bytes offsets[0] to offsets[1], less the words marked, which begin at `begin`, and the white space after them."""
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    pieces, at = [], int(offsets[0])
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        pieces.append(data[at : begin[i]].tobytes())
        at = int(begin[j]) if j < len(begin) else int(offsets[1])
    return b"".join([*pieces, data[at : offsets[1]].tobytes()]).decode("utf-8")


def ascending_packed(values: np.ndarray, limit: int) -> bytes:
    """Ascending integers below limit: their low bytes as they are, the rest as one bit each at its value plus its index."""
    n = len(values)
    low = 0 if limit < 16 * n else 1 if limit < 2048 * n else 2 if limit < (n << 19) else 4
    values = values.astype(np.int64)
    bits = np.zeros((int(values[-1]) >> 8 * low) + n if n else 0, np.uint8)
    bits[(values >> 8 * low) + np.arange(n)] = 1
    planes = [(values >> 8 * i).astype(np.uint8).tobytes() for i in range(low)]
    return b"".join([bytes([low]), np.uint32(n).tobytes(), *planes, np.packbits(bits).tobytes()])


def ascending_read(blob: bytes) -> np.ndarray:
    low, n = blob[0], int(np.frombuffer(blob, np.uint32, 1, 1)[0])
    out = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=5 + low * n))) - np.arange(n)
    for i in reversed(range(low)):
        out = out << 8 | np.frombuffer(blob, np.uint8, n, 5 + i * n)
    return out


def ascending_count(blob: bytes) -> int:
    return int(np.frombuffer(blob, np.uint32, 1, 1)[0])
