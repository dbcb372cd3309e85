"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut into words where no piece can cross: before a run of spaces, and around bytes that no piece holds. Distinct
words of a batch are encoded once, all words of one length together: for each end, the hashes of up to the longest
piece's substrings probe the sorted piece keys of all words at once, and the best start of each word (a vectorised
maximum) is stored as its backpointer.

Scores: for a unigram model the sum of piece scores. A BPE model's result is defined by merge order, not by a sum; there a
step scores 0 if the piece and the one before it are what merging their joined string gives, and minus infinity
otherwise, which leaves the one path that merging would take. Words of over LONG characters advance as many stretches at
once, joined where two neighbours' tables agree; those that don't agree are done again as one. In a run of spaces whose pieces all rank alike and after all others, only the last
space goes with the word; the run before it has one result for its length. Characters outside the vocabulary become byte pieces (or the unknown piece without them).

The model file is read on the driver, a parameter; nothing is trained. Supported: the identity normaliser.

Defined cases: a null text has no pieces and decodes to the empty text; the empty text likewise; texts that hold U+2581
itself decode with a space in its place, as the format cannot tell them apart; repeated rows are separate rows; an empty
table gives an empty result; extra columns pass through `encode` and `decode`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandmill.llm import textkit
from strandmill.llm.ppm import _Slots
from strandmill.llm.textkit import U64, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_B = U64(0x9E3779B97F4A7C15)
NORMAL, UNKNOWN, BYTE = 1, 2, 6
BATCH_WORDS = 20_000
CHUNK_BYTES = 1_000_000  # of text that a worker encodes at once
MEMO_WORDS = 500_000  # distinct words whose ids a worker keeps
LONG = 400  # characters of a word beyond which its stretches advance together
STEP, OVERLAP = 240, 80
RUN, PERIOD = 160, 48  # PERIOD: a multiple of the usual lengths of pieces that repeat one character
LONG_ROWS = 2_000
NEVER = np.int64(1 << 60)


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[i : i + n]
            i += n


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, as rows."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _code_hash(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) + U64(1))


def _stretches(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[a:a + n] for each a, n, joined."""
    before = np.cumsum(size) - size
    return flat[np.repeat(at - before, size) + np.arange(int(size.sum()))]


class Model:
    """The vocabulary as arrays. Own ids are piece ids; a character outside the vocabulary has the id `size`."""

    def __init__(self, data: bytes):
        pieces, self.kind, bytes_too, dummy = [], 1, False, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode("utf-8"), float(np.frombuffer(own.get(2, bytes(4)), np.float32)[0]), own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, bytes_too = own.get(3, 1), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                if own.get(1, b"identity") not in (b"identity", b"") or own.get(2) or own.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps white space is supported")
                dummy = bool(own.get(3, 1))
        if self.kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.dummy, self.size = dummy, len(pieces)
        self.text = [p for p, _, _ in pieces]
        self.score = np.array([s for _, s, _ in pieces] + [min([s for _, s, k in pieces if k == NORMAL], default=0.0) - 10.0])
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.plain = np.zeros(self.size + 1, bool)
        raw = []
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i
                raw.append(bytes([int(p[3:-1], 16)]))
            else:
                self.plain[i] = k == NORMAL
                raw.append(p.replace(SPACE, " ").encode() if k in (NORMAL, UNKNOWN) else b"")
        self.bytes_too = bytes_too
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        own = np.flatnonzero(self.plain)
        self.length = np.ones(self.size + 1, np.int64)
        self.hash = np.zeros(self.size + 1, U64)
        for i in own:
            self.length[i] = len(self.text[i])
        self.longest = int(self.length.max())
        self.power = textkit.powers(self.longest + 2, int(_B))
        for n in np.unique(self.length[own]):
            some = own[self.length[own] == n]
            h = np.zeros(len(some), U64)
            for column in _code_hash(_codes([self.text[i] for i in some])).T:
                h = h * _B + column
            self.hash[some] = h
        order = own[np.argsort(self.hash[own])]
        self.sorted_ids, self.slots = order, _Slots(self.hash[order])
        held = set("".join(self.text[i] for i in own))
        self.breaks = np.zeros(256, bool)
        self.breaks[[b for b in range(128) if b != 32 and chr(b) not in held]] = True
        self._merge_order(own)
        self.memo = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots.find(hashes)
        return np.where(at >= 0, self.sorted_ids[at], -1) if len(self.sorted_ids) else np.full(len(hashes), -1)

    def _merge_order(self, own) -> None:
        """rank: when merging makes the piece, characters first; left, right: its last merge; plain is cleared where merging can't make it."""
        self.ids = {self.text[i]: int(i) for i in own}
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        self.spaces_last, self.runs = False, {}
        if self.kind != 2:
            return
        _, place = np.unique(-self.score[own], return_inverse=True)
        self.rank[own] = np.where(self.length[own] > 1, place, -1)
        for i in own[self.length[own] > 1]:
            parts, last = self.merged(self.text[i])
            if len(parts) == 1:
                self.left[i], self.right[i] = self.ids[last[0]], self.ids[last[1]]
            else:
                self.plain[i] = False
        self.reachable = self.plain.copy()
        runs = np.array([i for i in own if set(self.text[i]) == {SPACE}], np.int64)
        others = np.array([i for i in own if self.length[i] > 1 and set(self.text[i]) != {SPACE}], np.int64)
        # Runs of spaces whose pieces all rank alike and after all others: no piece holds two spaces and more.
        self.spaces_last = bool(len(runs)) and SPACE in self.ids and len(set(self.score[runs].tolist())) == 1 and not (len(others) and self.score[others].min() <= self.score[runs[0]]) and not any(SPACE * 2 in self.text[i] for i in others)

    def merged(self, word: str):
        """The pieces that merging makes of the word, best score first, then leftmost; and the last merge."""
        parts, last = list(word), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined string of pieces a and b gives a and b. Goes back in time through the right edge of a and the left edge of
        b, latest merge first: a merge across must not come before the next one within."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        next_x, next_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            known = (x < self.size) & (y < self.size)
            across = np.full(len(at), -1)
            across[known] = self.find(self.hash[x[known]] * self.power[self.length[y[known]]] + self.hash[y[known]])
            when = np.where(across >= 0, self.rank[across], NEVER)
            bad = (when < next_x) & (when <= next_y) & (across >= 0)
            out[at[bad]] = False
            later_x = self.rank[x] > self.rank[y]
            more = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y, next_x, next_y, later_x = at[more], x[more], y[more], next_x[more], next_y[more], later_x[more]
            next_x, next_y = np.where(later_x, self.rank[x], next_x), np.where(later_x, next_y, self.rank[y])
            x, y = np.where(later_x, self.right[x], x), np.where(later_x, y, self.left[y])
        return out

    def tables(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(back, last) for words of one length as rows of code points: for each end, where the best path's last piece starts, and that piece."""
        n, length = codes.shape
        hashes = _code_hash(codes)
        total = np.zeros((n, length + 1), U64)
        for i in range(length):
            total[:, i + 1] = total[:, i] * _B + hashes[:, i]
        best = np.full((n, length + 1), -np.inf, np.float32)  # single precision and the earliest of equal starts, as the format sums
        best[:, 0] = 0.0
        back = np.zeros((n, length + 1), np.int32)
        last = np.full((n, length + 1), -1, np.int32)
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            ids = self.find((total[:, [end]] - total[:, starts] * self.power[end - starts]).ravel()).reshape(n, -1)
            alone = ids[:, -1] < 0
            ids[alone, -1] = self.size
            step = np.where(ids >= 0, best[:, starts], -np.inf)
            if self.kind == 1:
                step = step + self.score[ids].astype(np.float32)
            else:
                w, s = np.nonzero(step > -np.inf)
                ok = self.reachable[ids[w, s]] | (ids[w, s] == self.size)
                step[w[~ok], s[~ok]] = -np.inf
                w, s = w[ok], s[ok]
                inner = starts[s] > 0
                w, s = w[inner], s[inner]
                wrong = ~self.stands(last[w, starts[s]].astype(np.int64), ids[w, s])
                step[w[wrong], s[wrong]] = -np.inf
            top = np.argmax(step, axis=1)
            rows = np.arange(n)
            best[:, end], back[:, end], last[:, end] = step[rows, top], starts[top], ids[rows, top]
        return back, last

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words of one length; a character outside the vocabulary is -10 minus its code point."""
        codes = _codes(words)
        n, length = codes.shape
        back, last = self.tables(codes)
        # Follow the backpointers of all words together.
        at = np.full(n, length)
        columns = []
        while (at > 0).any():
            live = at > 0
            own = np.where(live, last[np.arange(n), at], -2).astype(np.int64)
            start = back[np.arange(n), at]
            outside = own == self.size
            own[outside] = -10 - codes[outside, start[outside]].astype(np.int64)
            columns.append(own)
            at = np.where(live, start, 0)
        found = np.stack(columns[::-1], axis=1) if columns else np.zeros((n, 0), np.int64)
        real = found != -2
        return found[real], real.sum(axis=1)

    def long_word(self, word: str) -> np.ndarray:
        """The ids of a long word. A long run of one character is worked out shorter by a multiple of PERIOD; where the path then comes to the same piece
        twice, PERIOD apart, what lies between goes in as often again: all neighbours on the longer path stand, and only one path's do."""
        codes = _codes([word])[0]
        begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        size = np.diff(np.append(begins, len(codes)))
        times = np.where(size >= RUN + PERIOD, (size - RUN) // PERIOD, 0)
        if not times.any():
            return self.path(codes)[0]
        short = size - times * PERIOD
        ids, ends = self.path(np.repeat(codes[begins], short))
        out, done = [], 0
        for first, n, more in zip((np.cumsum(short) - short)[times > 0].tolist(), short[times > 0].tolist(), times[times > 0].tolist()):
            low, high = np.searchsorted(ends, (first + 1, first + n + 1))
            after = np.searchsorted(ends, ends[low:high] + PERIOD)
            same = np.flatnonzero((after < high) & (ends[np.minimum(after, high - 1)] == ends[low:high] + PERIOD) & (ids[np.minimum(after, high - 1)] == ids[low:high]))
            if not len(same):
                return self.path(codes)[0]
            begin, end = low + int(same[0]) + 1, int(after[same[0]]) + 1
            out += [ids[done:end], np.tile(ids[begin:end], more)]
            done = end
        return np.concatenate([*out, ids[done:]])

    def path(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of a long word's code points: its stretches of up to STEP characters and an overlap advance together, as words of one length.

        Each stretch's table holds what merging makes of all its prefixes. The path goes back from the word's end; within an overlap it passes to the
        stretch before at a place where both tables end in the same piece. Every two neighbours on it then stand in one table or the
        other, and only one path does. Stretches begin by a change of character, where there is one: within a run of one, tables that begin at
        different places of it don't meet. Of two beginnings within a run, one character apart, that one counts which agrees more often with the stretch before, as runs of
        pairs leave one character over or none. Stretches that still don't meet become one, and the path goes on from the stretch behind them.
        """
        n, (begins, ends) = len(codes), self._cuts(codes)
        tries = [(k, x) for k, b in enumerate(begins) for x in ((b, b + 1) if k and codes[b] == codes[b + 1] else (b,))]
        rows = np.zeros((len(tries), max(ends[k] - x for k, x in tries)), codes.dtype)  # a table's prefix does not depend on what follows it
        for i, (k, x) in enumerate(tries):
            rows[i, : ends[k] - x] = codes[x : ends[k]]
        parts = [self.tables(rows[a : a + LONG_ROWS]) for a in range(0, len(rows), LONG_ROWS)]
        back, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        stretches = []  # begin, end, back, last, and where the path came in
        for i, (k, x) in enumerate(tries):
            own = [x, ends[k], back[i], last[i], None]
            if len(stretches) == k:
                stretches.append(own)
            elif self._agree(stretches[k - 1], own) > self._agree(stretches[k - 1], stretches[k]):
                stretches[k] = own
        stretches[-1][4] = (0, n)
        out, found, k, x = [], [], len(begins) - 1, n
        while k or x:
            begin, end, back, last, _ = stretches[k]
            at = x - begin
            if k and at and x <= stretches[k - 1][1] and last[at] == stretches[k - 1][3][x - stretches[k - 1][0]]:
                k -= 1
                stretches[k][4] = (len(out), x)
            elif at:
                start = int(back[at])
                out.append(-10 - int(codes[begin + start]) if last[at] == self.size else int(last[at]))
                found.append(x)
                x = begin + start
            else:
                low = k - 1
                while low and end - stretches[low][0] < 2 * (end - begin):  # at least twice as long, so that few tries reach any place
                    low -= 1
                first = stretches[low][0]
                back, last = self.tables(codes[None, first:end])
                stretches[low : k + 1] = [[first, end, back[0], last[0], (0, n)]]
                k = min(low + 1, len(stretches) - 1)  # the stretch behind, or this one if there is none
                done, x = stretches[k][4]
                del out[done:], found[done:]
        return np.array(out[::-1], np.int64), np.array(found[::-1], np.int64)

    @staticmethod
    def _agree(one: list, other: list) -> int:
        """In how many places of their overlap the tables of two stretches end in the same piece."""
        begin, end = other[0] + 1, one[1] + 1
        return int((one[3][begin - one[0] : end - one[0]] == other[3][begin - other[0] : end - other[0]]).sum())

    def _cuts(self, codes: np.ndarray) -> tuple[list[int], list[int]]:
        """(begins, ends) of stretches: each begins a piece's length before the last change of character within STEP characters, unless that is
        hardly on, so that what merges across the change is there to put the run behind it in step."""
        n, changes, begins = len(codes), np.flatnonzero(codes[1:] != codes[:-1]) + 1, [0]
        while n - begins[-1] > STEP + OVERLAP:
            i = int(np.searchsorted(changes, begins[-1] + STEP + self.longest, side="right")) - 1
            at = int(changes[i]) - self.longest if i >= 0 else 0
            begins.append(at if at > begins[-1] + STEP // 8 else begins[-1] + STEP)
        return begins, [*(min(b + OVERLAP, n) for b in begins[1:]), n]

    def space_run(self, n: int) -> list[int]:
        """The ids of n spaces that merge after all else: the same as the first pieces of a longer run, again and again."""
        most = 6 * self.longest
        if n not in self.runs:
            if n <= most:
                parts, _ = self.merged(SPACE * n)
                self.runs[n] = [self.ids.get(p, -10 - ord(p[0])) for p in parts]
            else:
                lead = self.space_run(most)[0]
                size = int(self.length[lead])
                times = (n - most) // size + 1
                return [lead] * times + self.space_run(n - times * size)
        return self.runs[n]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the words, in which spaces are already U+2581."""
        order, flats, counts = [], [], []
        by_length: dict[int, list[int]] = {}
        ahead: dict[int, int] = {}  # spaces before the last one of a word, which merge after all else
        for i, w in enumerate(words):
            spaces = len(w) - len(w.lstrip(SPACE)) if self.spaces_last and w.startswith(SPACE * 2) else 0
            if spaces:
                w = words[i] = w[spaces - 1 :]
                ahead[i] = spaces - 1
            if self.kind == 2 and len(w) > LONG:
                order.append([i])
                flats.append(self.long_word(w))
                counts.append([len(flats[-1])])
            else:
                by_length.setdefault(len(w), []).append(i)
        for length, own in by_length.items():
            step = max(1, BATCH_WORDS * 8 // max(8, length))
            for a in range(0, len(own), step):
                ids, count = self.viterbi([words[i] for i in own[a : a + step]])
                order.append(own[a : a + step])
                flats.append(ids)
                counts.append(count)
        flat, count = np.concatenate([np.zeros(0, np.int64), *flats]), np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
        flat, count = self._with_bytes(flat, count)
        order = np.argsort(np.concatenate([np.zeros(0, np.int64), *order]).astype(np.int64))
        flat, count = _stretches(flat, (np.cumsum(count) - count)[order], count[order]), count[order]
        return self._with_spaces(flat, count, ahead) if ahead else (flat, count)

    def _with_spaces(self, flat: np.ndarray, count: np.ndarray, ahead: dict[int, int]):
        """Puts the runs of spaces before their words; a word's own first space joins the run if it merged with nothing."""
        first = np.cumsum(count) - count
        space = self.ids.get(SPACE, self.size)
        parts, at, count = [], 0, count.copy()
        for i, n in ahead.items():  # in the order of the words
            begin = int(first[i])
            alone = int(flat[begin]) == space
            run = np.array(self.space_run(n + alone), np.int64)
            parts += [flat[at:begin], run]
            at = begin + alone
            count[i] += len(run) - alone
        return np.concatenate([*parts, flat[at:]]).astype(np.int32), count

    def _with_bytes(self, flat: np.ndarray, count: np.ndarray):
        """Characters outside the vocabulary as their byte pieces, or as the unknown piece."""
        outside = np.flatnonzero(flat < 0)
        if not len(outside):
            return flat.astype(np.int32), count
        found = [self.byte_ids[list(chr(-10 - i).encode())] if self.bytes_too else np.array([self.unknown]) for i in flat[outside].tolist()]
        extra = np.array([len(f) - 1 for f in found])
        size = np.ones(len(flat), np.int64)
        size[outside] += extra
        word = np.repeat(np.arange(len(count)), count)
        out = np.repeat(flat, size)
        at = (np.cumsum(size) - size)[outside]
        out[np.concatenate([np.arange(a, a + len(f)) for a, f in zip(at.tolist(), found, strict=True)])] = np.concatenate(found)
        return out.astype(np.int32), count + np.bincount(word[outside], extra, minlength=len(count)).astype(np.int64)

    def _known(self, hashes: np.ndarray, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, at, count): the ids of distinct words by their hashes (ascending); words(i) gives the strings of those not met before by this worker."""
        have, start, count, flat = self.memo
        at = np.minimum(np.searchsorted(have, hashes), max(len(have) - 1, 0))
        new = np.flatnonzero(have[at] != hashes) if len(have) else np.arange(len(hashes))
        if len(new):
            ids, n = self.encode_words(words(new))
            if len(have) + len(new) > MEMO_WORDS:  # begin anew with the words of this batch
                old = np.setdiff1d(np.arange(len(hashes)), new)
                have, old_count = hashes[old], count[at[old]]
                flat = _stretches(flat, start[at[old]], old_count)
                start, count = np.cumsum(old_count) - old_count, old_count
            start = np.concatenate([start, len(flat) + np.cumsum(n) - n])
            have, count, flat = np.concatenate([have, hashes[new]]), np.concatenate([count, n]), np.concatenate([flat, ids])
            order = np.argsort(have)
            self.memo = have, start, count, flat = have[order], start[order], count[order], flat
            at = np.searchsorted(have, hashes)
        return flat, start[at], count[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of each row."""
        size = np.diff(offsets)
        lead = ((size > 0) & self.dummy).astype(np.int64)
        shift = np.cumsum(lead)
        out = np.full(len(data) + int(lead.sum()), 32, np.uint8)
        out[np.arange(len(data)) + np.repeat(shift, size)] = data
        begin = np.concatenate([[0], np.cumsum(size + lead)])
        space, stop = out == 32, self.breaks[out]
        head = np.zeros(len(out) + 1, bool)
        head[:-1] = space | stop
        head[1:-1] &= ~space[1:] | ~space[:-1]  # a run of spaces starts one word
        head[1:] |= stop
        head[begin] = True
        starts = np.flatnonzero(head[:-1])
        ends = np.append(starts[1:], len(out))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        hashes, index, where = np.unique(textkit.range_hash(textkit._BYTE_CODE[out], starts, ends), return_index=True, return_inverse=True)
        raw = out.tobytes()
        strings = lambda new: [raw[a:b].decode("utf-8").replace(" ", SPACE) for a, b in zip(starts[index[new]].tolist(), ends[index[new]].tolist(), strict=True)]
        flat, at, count = self._known(hashes, strings)
        own = count[where]
        every = np.concatenate([[0], np.cumsum(own)])
        return _stretches(flat, at[where], own), every[np.searchsorted(starts, begin)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of rows of ids; broken UTF-8 becomes U+FFFD."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        raw = self.raw[np.repeat(self.raw_at[ids], size) + np.arange(at[-1]) - np.repeat(at[:-1], size)].tobytes()
        edges = at[first].tolist()
        return [raw[a + (self.dummy and b > a and raw[a] == 32) : b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def load(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col, the piece ids of text_col, as array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    kept = [c for c in docs.columns if c != ids_col]

    def apply(batches):
        model = shared.value
        for batch in batches:
            for a, b, data, offsets in textkit.pieces(batch.column(text_col), CHUNK_BYTES):
                ids, first = model.encode(data, offsets)
                column = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), column], [*kept, ids_col])

    return docs.select(*kept).mapInArrow(apply, docs.select(*kept).schema.add(ids_col, T.ArrayType(T.IntegerType())))


def _list_view(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def decode(encoded: DataFrame, path: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with text_col, the text of the piece ids in ids_col."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    kept = [c for c in encoded.columns if c != text_col]

    def apply(batches):
        model = shared.value
        for batch in batches:
            texts = model.decode(*_list_view(batch.column(ids_col)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text_col])

    return encoded.select(*kept).mapInArrow(apply, encoded.select(*kept).schema.add(text_col, "string"))


def report(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (whether decoding gives the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def apply(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text")
            for a, b, data, offsets in textkit.pieces(texts, CHUNK_BYTES):
                ids, first = model.encode(data, offsets)
                back = model.decode(ids, first)
                raw, own = ids.astype("<i4").tobytes(), [data[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                digest = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                same = [t.encode() == o for t, o in zip(back, own, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first)), pa.array(digest), pa.array(same)], ["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, n_pieces long, ids_sha256 string, round_trip boolean")
