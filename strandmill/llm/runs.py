"""Periodic runs of words: suffix array, longest previous factors, LZ blocks, boundary extensions, bucketed copying.

A run of period q is a stretch of words in which words q apart are identical, that no neighbouring word extends, and that has no
smaller period. Reported are the runs of at least max(LEAST, 2 * q) words.

Texts are stretches of a task's batch: the words of many documents, each document ended by a word of its own, form one sequence, whose runs
are those of the documents. (1) Prefix doubling sorts the suffixes; in each round only those that still tie are sorted again. (2) The
common prefixes of neighbours in that order, and pointers to the nearest suffix on either side that begins earlier, give each place its
longest previous factor. (3) Those cut the sequence into LZ blocks. (4) A run that touches a block's boundary has fewer words of period than the
two blocks have words, so for each such period the matches around the boundary are extended both ways (Main). (5) A run inside
a block is a copy of an earlier one: runs lie in buckets by their start, and each long block takes over those within its source, in order.
Common prefixes and suffixes of any two places come from prefix sums of word numbers by powers of random bases, modulo two primes, by
doubling and halving steps. All but (5) and the walk of (3) is numpy over whole arrays, of O(n log n).

A run of at least LEAST words repeats at least LEAST / 2 words at its period, so documents without such a repeat skip all this.

Defined cases: a null or empty text has no words and no runs; a null id is an id (its text stays as it is where the query
rewrites texts by id); repeated rows are separate rows; a document is worked on by one task, in memory some 200 times its
number of words; an empty table gives an empty result; extra columns are not read by `report` and pass through `collapse`, whatever
their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandmill.llm import textkit
from strandmill.llm.textkit import U64

LEAST = 12  # words of a run
_PRIMES = (2147483647, 2147483629)  # the two largest primes below 2**31
_BASES = (1103515245, 1220703125)
_powers: list[np.ndarray] = []


def suffix_array(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of a sequence whose last value occurs once."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    head = np.concatenate([[True], values[order[1:]] != values[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    last = np.append(head[1:], True)
    tied = np.flatnonzero(~(head & last))  # places of the order whose suffixes still tie with a neighbour
    length = 1
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[at + length]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        tied = tied[~(head & np.append(head[1:], True))]
        length *= 2
    return order, rank


class Extender:
    """Lengths of common prefixes and suffixes of pairs of places."""

    def __init__(self, values: np.ndarray):
        self.n, self.sums, n = len(values), [], len(values)
        if not _powers or len(_powers[0]) < n + 1:
            _powers[:] = [_power_table(b, p, max(n + 1, 1 << 17)) for b, p in zip(_BASES, _PRIMES, strict=True)]
        for power, p in zip(_powers, _PRIMES, strict=True):
            total = np.zeros(n + 1, np.int64)
            np.cumsum((values % p) * power[:n] % p, out=total[1:])  # below 2**62 for any sequence in memory
            self.sums.append(total % p)

    def _same(self, a, b, length, scale) -> np.ndarray:
        """Whether the stretches of a length at a and at b > a are equal."""
        same = np.ones(len(a), bool)
        for total, p, s in zip(self.sums, _PRIMES, scale, strict=True):
            same &= (total[a + length] - total[a]) % p * s % p == (total[b + length] - total[b]) % p
        return same

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """For pairs a < b the length of what agrees from both on, or up to and with both."""
        found = np.zeros(len(a), np.int64)
        if not len(a):
            return found
        scale = [power[b - a] for power in _powers]
        most = a + 1 if back else self.n - b

        def agrees(which, length):
            x, y = a[which], b[which]
            begin = -found[which] - length + 1 if back else found[which]
            return self._same(x + begin, y + begin, length, [s[which] for s in scale])

        step, alive = 1, np.flatnonzero(most > 0)
        failed = np.zeros(len(a), np.int64)  # the step at which a pair stopped
        while len(alive):
            fits = found[alive] + step <= most[alive]
            go = np.zeros(len(alive), bool)
            go[fits] = agrees(alive[fits], step)
            failed[alive[~go]] = step
            alive = alive[go]
            found[alive] += step
            step *= 2
        step = int(failed.max()) // 2
        while step:
            which = np.flatnonzero((failed > step) & (found + step <= most))
            which = which[agrees(which, step)]
            found[which] += step
            step //= 2
        return found


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * (int(out[-1]) * base % prime) % prime])
    return out


def previous_factors(order: np.ndarray, extender: Extender) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest factor at each place that also begins earlier."""
    n = len(order)
    low = np.minimum(order[1:], order[:-1])
    beside = np.concatenate([[0], extender.common(low, np.maximum(order[1:], order[:-1])), [0]])  # of the neighbours i - 1 and i of the order
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for side in (-1, 1):
        to = np.arange(n) + side
        least = beside[:-1].copy() if side < 0 else beside[1:].copy()
        going = np.flatnonzero(least)
        while len(going := going[order[to[going]] > order[going]]):
            # A later suffix beside: go on to where it points to. What lies between is later still.
            via = to[going]
            least[going], to[going] = np.minimum(least[going], least[via]), to[via]
            going = going[least[going] > 0]
        better = np.flatnonzero(least > length[order])
        length[order[better]], source[order[better]] = least[better], order[to[better]]
    return length, source


def lz_blocks(length: np.ndarray) -> np.ndarray:
    """The places where blocks begin: each takes the longest previous factor, or one new value."""
    steps, starts, at = np.maximum(length, 1).tolist(), [], 0
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    return np.array(starts, np.int64)


def boundary_runs(values: np.ndarray, starts: np.ndarray, extender: Extender, least: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of all stretches that touch the beginning of a block or the end, the end included."""
    n = len(values)
    size = np.diff(np.append(starts, n))
    bound, both = np.append(starts[1:], n), size + np.append(size[1:], 0)
    keep = both > least // 2  # the repeat, of least / 2 values or more, lies in the two blocks and doesn't fill them
    bound, both = bound[keep], both[keep] - 1
    b = np.repeat(bound, both)
    p = np.arange(len(b)) - np.repeat(np.cumsum(both) - both, both) + 1
    found = set()
    for first in (b - p, b):  # the pair of values a period apart that ends, or begins, at the boundary
        here, before = (first >= 0) & (first + p < n), (first > 0) & (first - 1 + p < n)
        here[here] = values[first[here]] == values[first[here] + p[here]]
        before[before] = values[first[before] - 1] == values[first[before] - 1 + p[before]]
        at = np.flatnonzero(here | before)
        ahead, behind = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        i, j = np.flatnonzero(here[at]), np.flatnonzero(before[at])
        ahead[i] = extender.common(first[at[i]], first[at[i]] + p[at[i]])
        behind[j] = extender.common(first[at[j]] - 1, first[at[j]] - 1 + p[at[j]], back=True)
        long = ahead + behind >= np.maximum(p[at], least - p[at])
        at, start, matches = at[long], (first[at] - behind)[long], (ahead + behind)[long]
        found.update(zip(start.tolist(), (start + matches + p[at] - 1).tolist(), p[at].tolist(), strict=True))
    return found


def maximal_runs(values: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs of at least max(least, 2 * period) values. The last value occurs once."""
    order, _ = suffix_array(values)
    extender = Extender(values)
    length, source = previous_factors(order, extender)
    starts = lz_blocks(length)
    buckets: dict[int, dict[int, int]] = {}  # start: end: smallest period
    for start, end, period in boundary_runs(values, starts, extender, least):
        ends = buckets.setdefault(start, {})
        ends[end] = min(period, ends.get(end, period))
    own = length[starts]
    for block in np.flatnonzero(own >= least + 2):
        at, begin, n = int(starts[block]), int(source[starts[block]]), int(own[block])
        for x in range(begin + 1, begin + n - least):
            for end, period in list(buckets.get(x, {}).items()):
                if end < begin + n - 1:
                    ends, copy = buckets.setdefault(x + at - begin, {}), end + at - begin
                    ends[copy] = min(period, ends.get(copy, period))
    rows = sorted((start, period, end - start + 1) for start, ends in buckets.items() for end, period in ends.items())
    return np.array(rows, np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _repeating(word: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Which rows have `least` words in a row more than once."""
    count = np.maximum(np.diff(first) - least + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    begin = first[row] + np.arange(at[-1]) - at[row]
    key = textkit.range_hash(word, begin, begin + least) ^ textkit.mix(row.astype(U64) + U64(1))
    order = np.argsort(key)
    again = row[order[1:]][key[order[1:]] == key[order[:-1]]]
    return np.unique(again)


def row_runs(word: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(row, runs): the runs of rows of words, given by hashes and each row's first word; runs as in maximal_runs, starts within the row."""
    rows = _repeating(word, first, least // 2)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    n = np.diff(first)[rows]
    begin = np.cumsum(n + 1) - n - 1  # of each row in the sequence, where a value of its own follows it
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    values = np.empty(int(n.sum()) + len(rows), np.int64)
    _, number = np.unique(word[inside + np.repeat(first[rows], n)], return_inverse=True)
    values[inside + np.repeat(begin, n)] = number + len(rows)
    values[begin + n] = np.arange(len(rows))
    runs = maximal_runs(values, least)
    of = np.searchsorted(begin, runs[:, 0], side="right") - 1
    runs[:, 0] -= begin[of]
    return rows[of], runs


def covered(first: np.ndarray, row: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each word lies in a run after the run's first period."""
    n = int(first[-1]) + 1
    begin = first[row] + runs[:, 0]
    return np.cumsum(np.bincount(begin + runs[:, 2], minlength=n) - np.bincount(begin + runs[:, 1], minlength=n))[:-1] > 0


def rewritten(ids: list, first: np.ndarray) -> np.ndarray:
    """For each word the one to take instead, by the rule of the query: texts whose id's crc32 ends in 0 repeat a period from some word on."""
    take = np.arange(int(first[-1]))
    for r, (doc_id, begin, end) in enumerate(zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = end - begin
        if n and doc_id is not None:
            h = zlib.crc32(str(doc_id).encode())
            if h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                take[begin + a : end] = begin + a + np.arange(n - a) % p
    return take


REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the words that stay, for every document after the query's rewriting."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = lambda raw: hashlib.sha256(raw).hexdigest()

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, data, offsets in textkit.pieces(batch.column("text")):
                starts, ends, first = textkit.words(data, offsets)
                take = rewritten(ids[a:b], first)
                starts, ends = starts[take], ends[take]
                row, runs = row_runs(textkit.word_hashes(data, starts, ends), first)
                kept = np.flatnonzero(~covered(first, row, runs))
                raw, begins, stops = textkit.joined(data, starts[kept], ends[kept])
                low = np.searchsorted(kept, first).tolist()
                cut = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                out = []
                for r in range(b - a):
                    x, y = low[r], low[r + 1]
                    own = runs[cut[r] : cut[r + 1]].tolist()
                    best = min(own, key=lambda t: (-t[1], t[0], t[2])) if own else None
                    lines = "".join(f"{s},{n},{p}\n" for s, n, p in own)
                    out.append((len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines.encode()), digest(raw[begins[x] : stops[y - 1]] if y > x else b"")))
                columns = zip(*out, strict=True)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(f.split()[0] for f in REPORT.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {REPORT}")


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs, with each run in text cut down to its first period. White space around kept words stays, texts without runs stay byte for
    byte, n_chars (where there is one) follows the text."""
    from pyspark.sql import functions as F

    sealed = textkit.sealed(docs)

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, _, data, offsets in textkit.pieces(batch.column("text")):
                starts, ends, first = textkit.words(data, offsets)
                row, runs = row_runs(textkit.word_hashes(data, starts, ends), first, least)
                gone = covered(first, row, runs)
                for r in np.unique(row).tolist():
                    texts[a + r] = textkit.without(data, offsets[r : r + 2], starts[first[r] : first[r + 1]], gone[first[r] : first[r + 1]])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    cleaned = textkit.unsealed(sealed.select("row", "text").mapInArrow(work, sealed.select("row", "text").schema), docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
