"""Prediction by partial matching over bytes: a context trie, partitioned over the cluster, scores every text.

Symbols are the bytes of the lower-cased (A-Z) UTF-8 text and one end symbol. The trie holds the counts of all strings of
up to ORDER + 1 symbols in the training texts; a context is such a string and its children are the symbols seen after it.
A symbol is coded in the longest context known; where it hasn't followed, the coder escapes to the next shorter one, and
symbols of the contexts escaped from are excluded there; below the empty context all symbols left are equally likely. The
escape mass is estimated by absolute discounting: each child gives up DISCOUNT of its count, and what pruned children
counted goes to the escape whole, so the probabilities of all symbols sum to one in every context.

Training counts every byte of every training text, and a string stays in the trie if it occurs LEAST times, whatever the size of
the corpus. A symbol's score depends on the ORDER + 1 symbols that end in it. Texts are dealt into blocks of about BLOCK bytes; a
block ships its distinct strings of that length, with their training counts, by the last HEAD context symbols. A part so has
every longer context with its children and suffixes: it builds its share of the trie, scores its strings and sends the scores
back to the blocks, which add them up by text. Strings of up to HEAD symbols are in every part: they are counted beforehand,
collected and broadcast, at most 2^24 and as many as there are different runs of three bytes, which a larger corpus hardly adds to.
Contexts of HEAD symbols that would fill much of a part are dealt by one symbol more; their children, at most 255 a context and one
context for HOT_PARTS parts, are broadcast with the rest. The words of the baseline go the same way: a block ships its distinct words,
parts add up their training counts and answer.

Exclusion costs no sets: the symbols seen after a context are a subset of those after its suffix, so the excluded count
of a suffix is a sum stored with the longer context, and scoring takes a few lookups a symbol.

Defined cases: a null text is an empty text, which is the end symbol alone; without training texts symbols are equally
likely; repeated rows count each; a null id counts as the empty string in the fold; an empty table gives an empty result;
columns other than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.llm.features import fold
from strandmill.llm.textkit import U64

ORDER = 6
HEAD = 3
BLOCK = 6_000_000  # bytes of text
PART = 12_000_000  # bytes of text for each part of the trie
LEAST_PARTS = 54
HOT_PARTS = 2.0  # a context of more symbols than so many parts have on average is hot
LEAST = 3
DISCOUNT = 0.6
FLUSH = 24_000_000
START, END = 0xFE, 0xFF
SYMBOLS = 255  # bytes of UTF-8 and END; START is never coded


def padded(data: np.ndarray, offsets: np.ndarray, order: int):
    """(symbols, coded): each row as order START symbols, its lower-cased bytes and END; and the places of the coded symbols."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    begin = offsets[:-1] + np.arange(n) * (order + 1)
    out = np.full(len(data) + n * (order + 1), START, dtype=np.uint8)
    row = np.repeat(np.arange(n), size)
    out[np.arange(len(data)) + (row + 1) * (order + 1) - 1] = textkit.lower(data)
    out[begin + order + size] = END
    coded = np.ones(len(out), dtype=bool)
    coded[(begin[:, None] + np.arange(order)).ravel()] = False
    return out, coded


def strings(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each place, the last `length` symbols as an integer, the last one lowest; before the start they are START."""
    one = np.concatenate([np.full(length - 1, START, np.uint8), symbols]).astype(U64)
    out, size, step, width = None, 0, one, 1
    while True:  # strings of 1, 2, 4 ... symbols, put together as the length has bits
        if length & width:
            out, size = (step, width) if out is None else (out[width:] | (step[: len(step) - size] << U64(8 * size)), size + width)
        if 2 * width > length:
            return out
        step, width = step[width:] | (step[:-width] << U64(8 * width)), 2 * width


def suffix(keys: np.ndarray, length: int) -> np.ndarray:
    return keys if length >= 8 else keys & U64((1 << (8 * length)) - 1)


def tally(keys: np.ndarray, counts=None):
    keys, where = (np.sort(keys), None) if counts is None else (keys, np.argsort(keys, kind="stable"))
    if where is not None:
        keys, counts = keys[where], counts[where]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(head, len(keys))) if counts is None else np.add.reduceat(counts, head) if len(head) else counts
    return keys[head], sums.astype(np.int64)


class Trie:
    """Sorted tables for each string length m: its count, and as a context its children and escape sums."""

    def __init__(self, order: int, nodes: list[tuple[np.ndarray, np.ndarray]], contexts=None):
        """nodes[m]: (keys ascending, counts) of the strings of m symbols, m from 0; nodes[0] is the empty string's total.
        contexts: the same for the strings that are contexts, where these are not the nodes (in a part of the trie)."""
        self.order = order
        self.total = int(nodes[0][1].sum())
        contexts = nodes if contexts is None else contexts
        self.keys = [contexts[m][0] for m in range(order + 1)]
        self.slots = [_Slots(k) for k in self.keys]
        strings_ = [nodes[m][0] for m in range(order + 2)]
        self.string_slots = self.slots + [_Slots(strings_[-1])] if contexts is nodes else [_Slots(k) for k in strings_]
        count = [contexts[m][1].astype(np.float64) for m in range(order + 1)]
        times = [nodes[m][1].astype(np.float64) for m in range(order + 2)]
        kept, kinds, excluded = [], [], []
        for m in range(order + 1):
            child, n = strings_[m + 1], times[m + 1]
            coded = (child & U64(255)) != U64(START)  # START after START is counted to total its context, never coded
            child, n = child[coded], n[coded]
            parent = np.searchsorted(self.keys[m], child >> U64(8))
            size = len(self.keys[m])
            kept.append(np.bincount(parent, n, minlength=size))
            kinds.append(np.bincount(parent, minlength=size))
            below = times[m][np.searchsorted(strings_[m], suffix(child, m))] if m else n * 0
            excluded.append(np.bincount(parent, below, minlength=size))
        self.count = [c.astype(np.float32) for c in times]
        # room[m][c]: the mass shared in context c when nothing is excluded; room_under: in its suffix, after escaping from c.
        self.room, self.escape, self.room_under, self.escape_under = [], [], [], []
        for m in range(order + 1):
            pruned = np.maximum(count[m] - kept[m], 0) if m else np.array([self.total - kept[0].sum()])
            room = kept[m] + pruned
            self.room.append(room)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escape.append(np.where(kinds[m] > 0, np.log10((DISCOUNT * kinds[m] + pruned) / room), 0.0))
                if m:
                    low = np.searchsorted(self.keys[m - 1], suffix(self.keys[m], m - 1))
                    left = np.maximum(kept[m - 1][low] - excluded[m], 0)
                    pruned_low = np.maximum((count[m - 1][low] if m > 1 else self.total) - kept[m - 1][low], 0)
                    kinds_left = kinds[m - 1][low] - kinds[m]
                    room = left + pruned_low
                    self.room_under.append(room)
                    self.escape_under.append(np.where(room > 0, np.log10((DISCOUNT * kinds_left + pruned_low) / room), 0.0))
                else:
                    self.room_under.append(room)
                    self.escape_under.append(np.zeros(1))
        self.usable = [k > 0 for k in kinds]
        self.floor = -np.log10(max(1, SYMBOLS - int(kinds[0][0]))) if len(kinds[0]) else -np.log10(SYMBOLS)
        # way_down[m][c]: all escapes below context c, from its suffix to the empty context.
        self.way_down = [np.zeros(1)]
        for m in range(1, order + 1):
            low = np.searchsorted(self.keys[m - 1], suffix(self.keys[m], m - 1))
            self.way_down.append(self.escape_under[m] + self.way_down[m - 1][low])
        for name in ("room", "escape", "room_under", "escape_under", "way_down"):
            setattr(self, name, [x.astype(np.float32) for x in getattr(self, name)])

    def scores(self, symbols: np.ndarray, coded: np.ndarray) -> np.ndarray:
        """log10 of the probability of each coded symbol."""
        place = np.flatnonzero(coded)
        full = strings(symbols, self.order + 1)
        return self.of(full[place], full[place - 1])

    def of(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last symbol of each target after its context, both as integers."""
        n = len(target)
        # The longest context with children, and its index.
        top, top_at = np.zeros(n, np.int8), np.zeros(n, np.int64)
        left = np.arange(n)
        for m in range(self.order, 0, -1):
            at = self.slots[m].find(suffix(context[left], m))
            known = at >= 0
            known[known] = self.usable[m][at[known]]
            top[left[known]], top_at[left[known]] = m, at[known]
            left = left[~known]
        # The longest string ending in the symbol, not longer than that context and the symbol.
        hit, hit_count = np.full(n, -1, np.int8), np.zeros(n, np.float32)
        left = np.arange(n)
        for m in range(self.order, -1, -1):
            mine = left[top[left] >= m]
            at = self.string_slots[m + 1].find(suffix(target[mine], m + 1))
            known = at >= 0
            hit[mine[known]], hit_count[mine[known]] = m, self.count[m + 1][at[known]]
            left = left[hit[left] < 0]
        out = np.zeros(n, np.float64)
        for m in range(self.order + 1):
            mine = np.flatnonzero(top == m)
            if not len(mine) or not len(self.keys[m]):
                continue
            at = top_at[mine]
            direct = hit[mine] == m
            out[mine[direct]] = np.log10((hit_count[mine[direct]] - DISCOUNT) / self.room[m][at[direct]])
            lower, at = mine[~direct], at[~direct]
            out[lower] = self.escape[m][at] + self.way_down[m][at]
            out[lower[hit[lower] < 0]] += self.floor
            for k in range(m):  # coded in the context of length k, after escaping from the one of length k + 1
                own = lower[hit[lower] == k]
                if len(own):
                    above = at[hit[lower] == k] if m == k + 1 else self.slots[k + 1].find(suffix(context[own], k + 1))
                    out[own] += np.log10(np.maximum(hit_count[own] - DISCOUNT, 1e-9) / self.room_under[k + 1][above]) - self.way_down[k + 1][above]
        if not len(self.keys[0]) or not self.total:
            out[:] = self.floor
        return out


class _Slots:
    """An open-addressing table of sorted distinct keys; find gives their indices."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(len(keys), 1) - 1).bit_length())
        self.shift = U64(64 - bits)
        self.mask = (1 << bits) - 1
        self.index = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros(1 << bits, U64)
        todo = np.arange(len(keys))
        at = self._start(keys)
        while len(todo):
            free = self.index[at] < 0
            self.index[at[free]] = todo[free]  # of several, the last stays
            self.key[at[free]] = keys[todo[free]]
            left = self.index[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _start(self, keys):
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._start(keys)
        out = self.index[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found = self.index[at]
            out[todo] = found
            more = (found >= 0) & (self.key[at] != keys[todo])
            todo, at = todo[more], at[more]
        return out


# Training and scoring over a cluster.


def _packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers as compressed byte planes of their gaps."""
    gaps = np.diff(values, prepend=U64(0)) if len(values) else values
    return zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def _parted(part: np.ndarray, *columns):
    """(part, columns) for each part, the rows in their order."""
    narrow = len(part) and int(part.max()) < 1 << 15
    order = np.argsort(part.astype(np.int16) if narrow else part, kind="stable")  # 16 bits sort by radix
    part = part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), *(c[order[a:b]] for c in columns)


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def train(texts: DataFrame, order: int = ORDER, resolution: int | None = None) -> Trie:
    """The whole trie in one place, for texts whose trie fits there; `scored` is for any size. With a resolution, strings below that
    share of the symbols go too."""
    spark = texts.sparkSession
    sums = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).first()
    total = sums["n"] or 0
    least = max(LEAST, -(-total // resolution)) if resolution else LEAST
    n = textkit.partitions(spark)

    def count(batches):
        def ship(held):
            keys, counts = tally(np.concatenate(held))
            rows = [(p, _packed(k), zlib.compress(c.astype(np.int32).tobytes(), 1)) for p, k, c in _parted((textkit.mix(suffix(keys, 3)) % U64(n)).astype(np.int32), keys, counts)]
            return _batch(rows, ["part", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in textkit.pieces(batch.column("text")):
                symbols, coded = padded(data, offsets, order)
                coded[np.flatnonzero(~coded)[order - 1 :: order]] = True  # the last START stands for the contexts of the start
                held.append(strings(symbols, order + 1)[coded])
                size += len(held[-1])
                if size >= FLUSH:
                    yield ship(held)
                    held, size = [], 0
        if held:
            yield ship(held)

    def total_up(batches):
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            parts = [(_unpacked(k), np.frombuffer(zlib.decompress(c), np.int32).astype(np.int64)) for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            keys, counts = tally(np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([counts, *(c for _, c in parts)]))
        rows = []
        for m in range(1, order + 2):
            k, c = tally(suffix(keys, m), counts)
            if m >= 3:  # complete here; shorter strings are summed once more
                k, c = k[c >= least], c[c >= least]
            rows.append((m, _packed(k), c.tobytes()))
        if len(keys):
            yield _batch(rows, ["m", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

    counted = texts.select("text").mapInArrow(count, "part int, keys binary, counts binary").repartition(n, "part").mapInArrow(total_up, "m int, keys binary, counts binary")
    found = [[] for _ in range(order + 2)]
    for r in counted.collect():
        found[r["m"]].append((_unpacked(r["keys"]), np.frombuffer(r["counts"], np.int64)))
    nodes = [(np.zeros(1, U64), np.array([total]))]
    for some in found[1:]:
        k, c = tally(np.concatenate([np.zeros(0, U64), *(a for a, _ in some)]), np.concatenate([np.zeros(0, np.int64), *(b for _, b in some)]))
        nodes.append((k[c >= least], c[c >= least]))
    return Trie(order, nodes)


def _short_counts(texts: DataFrame, length: int, of=None) -> tuple[np.ndarray, np.ndarray]:
    """(strings of `length` symbols ascending, counts) over all texts; with `of`, only those whose first `length - 1` symbols are among it."""
    dealt = 8

    def count(batches):
        def ship(held):
            keys, counts = tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            rows = [(p, _packed(k), c.tobytes()) for p, k, c in _parted((keys % U64(dealt)).astype(np.int32), keys, counts)]
            return _batch(rows, ["part", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in textkit.pieces(batch.column("text")):
                symbols, coded = padded(data, offsets, length)
                keys = strings(symbols, length)[coded]
                held.append(tally(keys if of is None else keys[_among(keys >> U64(8), of)]))
                size += len(held[-1][0])
                if size >= FLUSH // 12:
                    held = [tally(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size >= FLUSH // 24:
                        yield ship(held)
                        held, size = [], 0
        if held and sum(len(k) for k, _ in held):
            yield ship(held)

    def add_up(table):
        keys, counts = tally(*(np.concatenate(x) for x in zip(*((_unpacked(k), np.frombuffer(c, np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)), strict=True)))
        return pa.Table.from_batches([_batch([(_packed(keys), counts.tobytes())], ["keys", "counts"], [pa.binary(), pa.binary()])])

    rows = texts.select("text").mapInArrow(count, "part int, keys binary, counts binary").groupBy("part").applyInArrow(add_up, "keys binary, counts binary").collect()
    return tally(np.concatenate([np.zeros(0, U64), *(_unpacked(r["keys"]) for r in rows)]), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)]))


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each key is among the ascending ones."""
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


def _often(keys: np.ndarray, counts: np.ndarray):
    return keys[counts >= LEAST], counts[counts >= LEAST]


def _merged(a, b):
    """(keys ascending, counts) of two disjoint such pairs."""
    keys, counts = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys)
    return keys[order], counts[order]


def _floats_packed(x: np.ndarray) -> bytes:
    """32-bit floats as byte planes, the one of the exponents entropy coded."""
    planes = np.ascontiguousarray(x.astype("<f4").view(np.uint8).reshape(-1, 4).T)
    top = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
    return planes[:3].tobytes() + top.compress(planes[3].tobytes()) + top.flush()


def _floats_read(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(blob[: 3 * n] + zlib.decompress(blob[3 * n :]), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<f4").ravel()


# The word baseline: counts of whole words.

END_WORD = U64(1)
WORD_PART = 24_000_000  # bytes of text for each part of the words


def _word_rows(column):
    """(row, hash) of every word of the lower-cased texts, and of one end a text."""
    for a, _, data, offsets in textkit.pieces(column):
        data = textkit.lower(data)
        starts, ends, first = textkit.words(data, offsets)
        rows = np.arange(a, a + len(offsets) - 1)
        yield np.concatenate([np.repeat(rows, np.diff(first)), rows]), np.concatenate([textkit.word_hashes(data, starts, ends), np.full(len(rows), END_WORD)])


def word_totals(texts: DataFrame, parts: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of all texts."""

    def count(batches):
        def ship(held):
            words, counts = tally(np.concatenate([w for w, _ in held]), np.concatenate([c for _, c in held]))
            return _batch([(p, _packed(w), int(c.sum())) for p, w, c in _parted((words % U64(parts)).astype(np.int32), words, counts)], ["part", "words", "n"], [pa.int32(), pa.binary(), pa.int64()])

        held, size = [], 0
        for batch in batches:
            for _, words in _word_rows(batch.column("text")):
                held.append(tally(words))
                size += len(held[-1][0])
            if size >= FLUSH // 4:
                yield ship(held)
                held, size = [], 0
        if held:
            yield ship(held)

    def add_up(table):
        words = np.zeros(0, U64)
        for blob in table.column("words").to_pylist():
            words = textkit.distinct(np.concatenate([words, _unpacked(blob)]))
        return pa.table({"n": [sum(table.column("n").to_pylist())], "v": [len(words)]})

    dealt = texts.select("text").mapInArrow(count, "part int, words binary, n long")
    sums = dealt.groupBy("part").applyInArrow(add_up, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return sums["n"] or 0, sums["v"] or 0


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs (doc_id, learn, text) with score, log10 of the probability of the text and its end, and n_tokens, n_known and base, the sum of
    log10(c + 0.5) over the tokens, in place of learn and text. Both models learn from the rows with learn."""
    spark = docs.sparkSession
    size = textkit.text_bytes(docs)
    blocks = max(textkit.partitions(spark), size // BLOCK)
    parts, word_parts = max(LEAST_PARTS, size // PART), max(6, size // WORD_PART)
    low, times = _short_counts(docs.where("learn"), HEAD)
    total = int(times.sum())
    # Contexts of HEAD symbols that fill much of a part are dealt by one symbol more; their children are counted beforehand too.
    hot = low[times * parts > HOT_PARTS * total] if total else low
    deep, deep_times = _short_counts(docs.where("learn"), HEAD + 1, hot) if len(hot) else (low[:0], times[:0])
    empty = (np.zeros(1, U64), np.array([total]))
    head = spark.sparkContext.broadcast(
        (
            [empty, *(_often(*tally(suffix(low, m), times)) for m in range(1, HEAD + 1)), _often(deep, deep_times)],
            [empty, *(_often(*tally(suffix(low >> U64(8), m), times)) for m in range(1, HEAD)), _often(*tally(deep >> U64(8), deep_times))],
            hot,
        )
    )

    def part_of(keys, hot):
        context = keys >> U64(8)
        own = suffix(context, HEAD)
        if len(hot):
            some = _among(own, hot)
            own[some] = suffix(context[some], HEAD + 1) | U64(1 << 63)
        return (textkit.mix(own) % U64(parts)).astype(np.int32)

    def found(table):
        """(rows, row of each symbol, string of each symbol) for stretches of a block."""
        for a, b, data, offsets in textkit.pieces(table.column("text")):
            symbols, coded = padded(data, offsets, order)
            yield np.repeat(np.arange(a, b, dtype=np.int32), np.diff(offsets) + 1), strings(symbols, order + 1)[coded]

    def distinct(stretches, learn):
        """The distinct keys of a block's stretches, and how often each occurs in rows to learn from."""
        every, own = [], []
        for rows, keys in stretches:
            every.append(keys)
            own.append(keys[learn[rows]])
        keys = textkit.distinct(np.concatenate(every))
        some, n = tally(np.concatenate(own))
        counts = np.zeros(len(keys), np.int32)
        counts[np.searchsorted(keys, some)] = n
        return keys, counts

    def distinct_strings(stretches, learn):
        """The same for strings, which leave a bit free to sort the flag along with them."""
        flagged = np.sort(np.concatenate([keys << U64(1) | learn[rows] for rows, keys in stretches]))
        keys = flagged >> U64(1)
        head_at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[head_at], np.add.reduceat(flagged & U64(1), head_at).astype(np.int32)

    def ship(table):
        """A block's distinct strings and words for each part, with their training counts."""
        learn, block = table.column("learn").to_numpy(), table.column("block")[0].as_py()
        keys, counts = distinct_strings(found(table), learn)
        rows = [(block, p, _packed(k), zlib.compress(c.tobytes(), 1)) for p, k, c in _parted(part_of(keys, head.value[2]), keys, counts)]
        keys, counts = distinct(_word_rows(table.column("text")), learn)
        rows += [(block, parts + p, _packed(k), zlib.compress(c.tobytes(), 1)) for p, k, c in _parted((keys % U64(word_parts)).astype(np.int32), keys, counts)]
        return pa.Table.from_batches([_batch(rows, ["block", "part", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])])

    def judge(table):
        """For each block, in the order of its keys: the scores of a part's strings, or the counts of its words."""
        blobs, part = table.column("keys").to_pylist(), table.column("part")[0].as_py()
        counts = np.concatenate([np.frombuffer(zlib.decompress(c), np.int32) for c in table.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = tally(np.concatenate([_unpacked(k) for k in blobs]), counts)
        if part >= parts:
            told = [zlib.compress(counts[np.searchsorted(keys, _unpacked(k))].tobytes(), 1) for k in blobs]
        else:
            scores = part_scores(keys, counts)
            told = [_floats_packed(scores[np.searchsorted(keys, _unpacked(k))]) for k in blobs]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "told": pa.array(told, pa.binary())})

    def part_scores(keys, counts):
        nodes, contexts, hot = head.value
        learnt, n = keys[counts > 0], counts[counts > 0]
        shallow = ~_among(suffix(learnt >> U64(8), HEAD), hot)  # these lie here with all that shares HEAD context symbols
        first = lambda k, m: _often(*tally(suffix(k[shallow], m), n[shallow]))
        own = [*nodes[: HEAD + 1], _merged(first(learnt, HEAD + 1), nodes[HEAD + 1]), *(_often(*tally(suffix(learnt, m), n)) for m in range(HEAD + 2, order + 2))]
        above = [*contexts[:HEAD], _merged(first(learnt >> U64(8), HEAD), contexts[HEAD]), *(_often(*tally(suffix(learnt >> U64(8), m), n)) for m in range(HEAD + 1, order + 1))]
        trie = Trie(order, own, above)
        return np.concatenate([trie.of(k, k >> U64(8)).astype(np.float32) for k in np.array_split(keys, -(-len(keys) // 500_000))])

    def add_up(table, told):
        of, n = dict(zip(told.column("part").to_pylist(), told.column("told").to_pylist(), strict=True)), table.num_rows
        stretches = list(found(table))
        keys = textkit.distinct(np.concatenate([k for _, k in stretches]))
        values = np.zeros(len(keys), np.float32)
        for p, at in _parted(part_of(keys, head.value[2]), np.arange(len(keys))):
            values[at] = _floats_read(of[p], len(at))
        slots, score = _Slots(keys), np.zeros(n)
        for rows, k in stretches:
            score += np.bincount(rows, values[slots.find(k)], minlength=n)
        del slots, values, stretches
        rows, words = (np.concatenate(x) for x in zip(*_word_rows(table.column("text")), strict=True))
        order = np.argsort(words)
        head_at = np.flatnonzero(np.concatenate([[True], words[order[1:]] != words[order[:-1]]]))
        keys = words[order[head_at]]
        times = np.zeros(len(keys), np.int64)
        for p, at in _parted((keys % U64(word_parts)).astype(np.int32), np.arange(len(keys))):
            times[at] = np.frombuffer(zlib.decompress(of[parts + p]), np.int64)
        each = np.zeros(len(words), np.int64)
        each[order] = np.repeat(times, np.diff(np.append(head_at, len(words))))
        tokens, known = np.bincount(rows, minlength=n), np.bincount(rows[each > 0], minlength=n)
        base = np.bincount(rows, np.log10(each + 0.5), minlength=n)
        return pa.table({"doc_id": table.column("doc_id"), "score": score, "n_tokens": tokens, "n_known": known, "base": base})

    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    dealt = docs.select("doc_id", "learn", "text", block.alias("block"))
    judged = dealt.groupBy("block").applyInArrow(ship, "block int, part int, keys binary, counts binary").groupBy("part").applyInArrow(judge, "block int, part int, told binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(add_up, f"doc_id {kind}, score double, n_tokens long, n_known long, base double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document; learns from the rows whose
    crc32(doc_id) mod 5 is not 1."""
    held_out = fold("doc_id", 5) == 1
    rows = docs.select("doc_id", "text", (~held_out).alias("learn"))
    n, v = word_totals(rows.where("learn"), max(6, textkit.text_bytes(docs) // WORD_PART))
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    return scored(rows).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
