import math
import random
import re

import pytest

from strandmill.llm import mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    full = set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def test_targets_copies_and_cases(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "é", "z", None]) if i % 3 else "hot", " ".join(["w"] * rng.randint(0, 60))) for i in range(900)]
    rows += [(1000, "b", None), (1001, "b", "x y"), (1001, "b", "x y"), (None, "a", "q"), (1002, "empty", ""), (1003, "empty", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    source = {(r[0], len((r[2] or "").split())): r[1] for r in rows}
    taken = {}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.report(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def brute_draw(docs):
    """(doc_id, size, copies) by a running sum in plain Python, over Spark's hashes of the rows."""
    from pyspark.sql import functions as F

    hashed = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text", "source").alias("key"), F.xxhash64("source", F.lit("offset")).alias("offset"))
    rows = hashed.withColumn("luck", F.xxhash64("doc_id", "key", F.lit("order"))).collect()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r)
    want, out = fill(sizes), []
    for source in sizes:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (size(r), r["luck"]))
        share = want[source] / sizes[source] if sizes[source] else 0.0
        offset = own[0]["offset"] % (1 << 20) / (1 << 20)
        out += [(r["doc_id"], size(r), math.floor(share * (k + 1) + offset) - math.floor(share * k + offset)) for k, r in enumerate(own)]
    return out


def test_draws_match_brute_force(spark, tiny):
    rows = [(i, "bca"[i % 3], "w " * (i * 7 % 23)) for i in range(200)] + [(300, "b", "x y")] * 25 + [(301, None, None), (302, "only", ""), (None, "b", "q")]
    for docs in (spark.read.parquet(f"{tiny}/documents.parquet"), spark.createDataFrame(rows, "doc_id long, source string, text string")):
        got = [(r["doc_id"], r["size"], r["copies"]) for r in mixing.copies(docs).collect()]
        assert sorted(got, key=str) == sorted(brute_draw(docs), key=str)


def test_mix_emits_the_copies(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    words = {r["doc_id"]: r["taken"] for r in mixing.report(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in got.items() if v}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string, size long, target string")
    assert mixing.report(docs).collect() == [] and mixing.mix(docs).collect() == []
