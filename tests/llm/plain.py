"""Hashes and word cuts in plain Python integers and regular expressions, for the brute-force versions."""

import re

from strandmill.llm import textkit

M64 = (1 << 64) - 1
CODES = [int(c) for c in textkit._BYTE_CODE]
BASE = 0x9E3779B97F4A7C15


def mix(h):
    h &= M64
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def sequence_hash(values, base=BASE):
    total = 0
    for v in reversed(values):
        total = (total * base + v) & M64
    return mix(total + len(values))


def byte_hash(raw):
    return sequence_hash([CODES[b] for b in raw])


def lowered(raw):
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in raw)


def words(text):
    """(start, end, bytes) of the words of a text's UTF-8 bytes."""
    return [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
