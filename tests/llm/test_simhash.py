import random

import numpy as np
import pytest
import xxhash

from strandmill.llm import simhash


def brute(texts, width, most):
    """ids -> (fingerprint, component) the slow way."""
    import re

    fps = {}
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (format(fps[i], "016x"), find(i)) for i in ids}


def made_texts(n=300):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = (rng.choice(out)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 40, 400]))
        out.append((i, " ".join(words)))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One  TWO\tthree"), (n + 4, "one two three"), (n + 5, "wörd " * 3000)]


def test_matches_brute_force(spark):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.linked(docs).collect()}
    assert got == brute(texts, 3, 3)


def test_whole_table_components(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.linked(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 3)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (None, "z")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.linked(docs).collect())
    assert rows == [(-1, -1), (2, 2), (4, 2), (4, 2)]
    assert simhash.linked(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_buckets_lose_no_link(seed):
    """Thousands of fingerprints around a few centres, filed under one key: the links span the same components as all pairs."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.repeat(centre, 400)
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(16, 64, len(fp)).astype(np.uint64))
    fp = np.unique(fp)
    free = np.full(len(fp), ((1 << 64) - 1) ^ 0xFFFF, dtype=np.uint64)
    a, b = simhash._links(np.zeros(len(fp), np.uint64), fp, np.zeros(len(fp), bool), 3, free)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    x, y = np.nonzero(np.triu(near, 1))
    want_node, want_root = simhash.spanning(fp[x], fp[y])
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert {k: got[k] for k in got} == dict(zip(want_node.tolist(), want_root.tolist(), strict=True))


def test_thresholds_cover(spark):
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for most in (3, 5):
        plan = simhash.allocate(2000, bits.T @ bits, sample, most)
        assert sum(t + 1 for _, t in plan) == most + 1
        assert len({b for bits_, _ in plan for b in bits_}) == sum(len(bits_) for bits_, _ in plan)


def test_xxh64_of_ranges_equals_the_library():
    import random

    import numpy as np
    import xxhash

    from strandmill.llm import textkit

    rng = random.Random(1)
    raw = bytes(rng.choices(range(256), k=4000))
    spans = [(a, min(a + rng.choice([0, 1, 3, 4, 7, 8, 9, 31, 32, 33, 35, 63, 64, 65, 100, rng.randrange(900)]), 4000)) for a in rng.choices(range(4001), k=2000)]
    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    for seed in (42, 0, 2**63 + 5):
        assert textkit.xxh64(np.frombuffer(raw, np.uint8), starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in spans]
    none = np.zeros(0, np.int64)
    assert textkit.xxh64(np.zeros(0, np.uint8), none, none, 42).tolist() == []
