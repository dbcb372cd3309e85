"""SimHash near-duplicate linking by the generalised pigeonhole principle.

Fingerprint: bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles. Two texts
link if their fingerprints differ in at most `most` bits; components of links are the groups.

Search: co-occurrence counts over all distinct fingerprints put correlated bits into the same partition; partition i
gets its own threshold t(i), with sum t(i) = most - parts + 1, so any linked pair is within t(i) in at least one
partition. Dynamic programming allocates the thresholds (and the number of partitions) with the least estimated number
of probes and candidates, estimated on at most SAMPLE fingerprints. Every fingerprint is filed under its value in each
partition and probes all values within t(i); candidates are verified on all 64 bits. No pair is lost: crowded buckets
are filed again by the bits outside the partition, on which a linked pair must agree in one of most + 1 groups. Only
spanning links leave a task, never all pairs.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text with fewer words than a
shingle is one shingle; repeated rows keep their rows; a null id never names a component with other ids; an empty table
gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import itertools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import textkit
from strandmill.llm.components import components
from strandmill.llm.textkit import U64

SAMPLE = 16_384
CROWDED = 4_096  # bucket rows beyond which Spark files the bucket again, over the cluster
ROW_COST = 100.0  # of filing a fingerprint once, in comparisons of two
MOST_PROBES = 300  # of one fingerprint in one partition
DIRECT = 1_024  # bucket rows up to which a task compares directly
CHUNK = 400_000  # filed rows that a task compares at once
SEED = 42


def normal(data: np.ndarray, offsets: np.ndarray):
    """(bytes, starts, ends, first): words, A-Z lower-cased and joined by one space, and the words of each row."""
    starts, ends, first = textkit.words(data, offsets)
    size = ends - starts
    begins = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(begins[-1]), 32, dtype=np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[inside + np.repeat(begins[:-1], size)] = textkit.lower(data)[inside + np.repeat(starts, size)]
    return out, begins[:-1], begins[:-1] + size, first


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int):
    """(hashes, first): XXH64 of every shingle; row r has hashes[first[r]:first[r + 1]]."""
    text, starts, ends, first = normal(data, offsets)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1], count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
    end = np.minimum(begin + width, np.repeat(first[1:], count)) - 1
    return textkit.xxh64(text, starts[begin], ends[end], SEED), at


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row, the bits set in over half of its hashes: byte-wide counters over at most 255 hashes at a time."""
    n = np.diff(first)
    blocks = -(-n // 255)
    at = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(len(n), dtype=U64)
    if not at[-1]:
        return out
    begin = np.repeat(first[:-1], blocks) + 255 * (np.arange(at[-1]) - np.repeat(at[:-1], blocks))
    some = np.flatnonzero(n)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> U64(j)) & U64(0x0101010101010101), begin)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), at[some], axis=0)
        for k in range(8):
            out[some] |= (counts[:, k] * 2 > n[some]).astype(U64) << U64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, width: int, tables: int = 1) -> DataFrame:
    """docs with a column fp (bigint, the 64 bits) in place of the text; with more tables also fp1, fp2 ..., from remixed hashes."""
    names = ["fp", *(f"fp{t}" for t in range(1, tables))]
    kept = [c for c in docs.columns if c not in (*names, "text")]

    def apply(batches):
        for batch in batches:
            own = [[] for _ in names]
            for _, _, data, offsets in textkit.pieces(batch.column("text")):
                hashes, first = shingle_hashes(data, offsets, width)
                for found in own:
                    found.append(majority(hashes, first))
                    hashes = textkit.mix(hashes)
            columns = [pa.array(np.concatenate(f).view(np.int64) if f else np.zeros(0, np.int64)) for f in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *names])

    schema = docs.select(*kept).schema
    for name in names:
        schema = schema.add(name, "long")
    return docs.select(*kept, "text").mapInArrow(apply, schema)


# The plan of the search.


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(n, matrix): the number of fingerprints and, for each two bits, of those with both set; over all fingerprints."""

    def count(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = nodes.select("fp").mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(64 * 64 + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(64, 64)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy groups of 64 / parts bits: each starts at the bit most correlated with the rest and takes the bits closest to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def flips(bits, most: int) -> np.ndarray:
    """All masks of at most `most` of the bits."""
    return np.array([mask_of(c) for k in range(most + 1) for c in combinations(bits, k)], dtype=U64)


def allocate(n: int, both: np.ndarray, sample: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] with the least estimated cost, thresholds of -1 (never probed) left out."""
    best = None
    scale = (n / max(len(sample), 1)) ** 2
    for parts in range(2, most + 3):
        groups = correlated_parts(n, both, parts)
        cost = []
        for bits in groups:
            value, times = np.unique(sample & U64(mask_of(bits)), return_counts=True)
            row, pairs = {-1: 0.0}, 0.0
            for t in range(most + 1):
                if math.comb(len(bits), t) > MOST_PROBES:
                    break
                for mask in (mask_of(c) for c in combinations(bits, t)):
                    at = np.minimum(np.searchsorted(value, value ^ U64(mask)), len(value) - 1)
                    hit = value[at] == value ^ U64(mask)
                    pairs += float((times[hit] * (times[at[hit]] - (t == 0))).sum()) / 2
                row[t] = pairs * scale + n * ROW_COST * len(flips(bits, t))
            cost.append(row)
        plans = {0: (0.0, [])}  # by the sum of thresholds + 1
        for row in cost:
            plans = {s: min(((c + row[t], ts + [t]) for have, (c, ts) in plans.items() for t in row if have + t + 1 == s), key=lambda x: x[0]) for s in {have + t + 1 for have in plans for t in row}}
        found = plans.get(most + 1)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], [(bits, t) for bits, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


# Probing and verifying.


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that join the same nodes as the links a-b, one for each node but the roots."""
    if not len(a):
        return a, a
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == old).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[moved], nodes[label[moved]]


def _links(keys: np.ndarray, fp: np.ndarray, probe: np.ndarray, most: int, free: np.ndarray, depth: int = 0):
    """Links within buckets of equal key, where a link joins a filed row with any other row. free: for each row, the bits outside its key."""
    order = np.lexsort((fp, keys))
    keys, fp, probe, free = keys[order], fp[order], probe[order], free[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    size = np.diff(edge)
    room = np.repeat(size, size)
    found_a, found_b = [], []
    direct = room <= DIRECT if depth < 3 else np.ones(len(keys), bool)
    at = np.flatnonzero(direct & (room > 1))
    left = np.repeat(edge[1:], size)  # one past the bucket's last row
    shift = 1
    while len(at):
        at = at[at + shift < left[at]]
        other = at + shift
        near = (np.bitwise_count(fp[at] ^ fp[other]) <= most) & (fp[at] != fp[other]) & ~(probe[at] & probe[other])
        found_a.append(fp[at[near]])
        found_b.append(fp[other[near]])
        shift += 1
        if len(found_a) > 64:  # bounded memory: links so far shrink to spanning ones
            a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [a], [b]
    if not direct.all():
        rest = ~direct
        sub_keys, sub_free = refile(keys[rest], free[rest], fp[rest], most)
        again = np.tile(np.flatnonzero(rest), most + 1)
        a, b = _links(sub_keys, fp[again], probe[again], most, sub_free, depth + 1)
        found_a.append(a)
        found_b.append(b)
    if not found_a:
        return fp[:0], fp[:0]
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


def refile(keys: np.ndarray, free: np.ndarray, fp: np.ndarray, most: int):
    """New keys for the rows, most + 1 each: the old key and one of most + 1 groups of its free bits; and the bits free after that."""
    new, left = [], []
    for j in range(most + 1):
        own = np.zeros(len(free), dtype=U64)
        for mask in np.unique(free):
            bits = [b for b in range(64) if int(mask) >> b & 1]
            own[free == mask] = U64(mask_of(bits[j :: most + 1]))
        new.append(textkit.mix(keys ^ textkit.mix((fp & own) + U64(j * 2 + 1))))
        left.append(free & ~own)
    return np.concatenate(new), np.concatenate(left)


def links(nodes: DataFrame, most: int) -> DataFrame:
    """u, v: links that join exactly the components of fingerprints within `most` bits. nodes: distinct fp; with a column `tables`, of
    which only fingerprints of one table are compared (its fps must not occur in another)."""
    if "tables" not in nodes.columns:
        nodes = nodes.withColumn("tables", F.lit(0))
    n, both = bit_counts(nodes)
    sample = np.array([r["fp"] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(U64)
    plan = [(mask_of(bits), flips(bits, t)) for bits, t in allocate(n, both, sample, most)] if len(sample) else []

    def file(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            table = textkit.mix(batch.column("tables").to_numpy(zero_copy_only=False).astype(U64))
            for i, (mask, changes) in enumerate(plan):
                for change in changes:
                    key = textkit.mix((((fp ^ change) & U64(mask)) ^ table) + textkit.mix(np.full(1, i + 1, U64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), change != 0)), pa.array(np.full(len(fp), ~mask & (1 << 64) - 1, U64).view(np.int64))], ["key", "fp", "probe", "free"]
                    )

    schema = "key long, fp long, probe boolean, free long"
    filed = nodes.select("fp", "tables").mapInArrow(file, schema)

    def file_again(batches):
        for batch in batches:
            key, fp, free = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for c in ("key", "fp", "free"))
            probe = batch.column("probe").to_numpy(zero_copy_only=False)
            keys, left = refile(key, free, fp, most)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(fp, most + 1).view(np.int64)), pa.array(np.tile(probe, most + 1)), pa.array(left.view(np.int64))], ["key", "fp", "probe", "free"])

    crowded = textkit.cut(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key", F.lit(True).alias("crowded")))
    rows = filed
    if not crowded.isEmpty():  # their keys are few: a key of n rows is counted, and its rows stay where they are
        marked = filed.join(textkit.small(crowded), "key", "left")
        rows = marked.where("crowded is null").drop("crowded").union(marked.where("crowded").drop("crowded").mapInArrow(file_again, schema))

    def verify(batches):
        """Buckets come one after the other; whole ones are compared as soon as CHUNK rows are there."""
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                own = pa.Table.from_batches([batch])
                held = own if held is None else pa.concat_tables([held, own])
                if held.num_rows < CHUNK:
                    continue
            if held is None or not held.num_rows:
                return
            key, fp, free = (held.column(c).to_numpy().astype(np.int64).view(U64) for c in ("key", "fp", "free"))
            whole = len(key) if batch is None else int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))
            a, b = _links(key[:whole], fp[:whole], held.column("probe").to_numpy()[:whole], most, free[:whole])
            held = held.slice(whole)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    return rows.repartition(textkit.partitions(nodes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(verify, "u long, v long")


def group(docs: DataFrame, width: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id of the component) for every document."""
    marked = textkit.cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width))
    nodes = textkit.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, most))
    placed = textkit.cut(nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = textkit.cut(placed.select("fp", "root").join(textkit.cut(named), "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: 3-word shingles, links at 3 bits or fewer."""
    return group(docs, 3, 3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
