import bisect
import random
import zlib

import pytest

from strandmill.llm import queries, sharding


def check_shards(rows, got, shards, tolerance):
    assert len(got) == len(rows)
    size = {}
    for i, t in rows:
        size.setdefault((i, zlib.crc32((t or "").encode())), len((t or "").encode()) + 8)
    by_shard = {}
    for r in got:
        assert size[r["doc_id"], r["text_crc32"]] == r["size"] and r["law"] == "bytes" and r["grown_shard"] is None
        assert 0 <= r["shard"] < shards
        by_shard.setdefault(r["shard"], []).append(r)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total = sum(r["size"] for r in got)
    for own in by_shard.values():
        assert abs(sum(r["size"] for r in own) - total / shards) <= tolerance * total / shards
    return by_shard


def test_hot_group_is_split_and_others_stay_whole(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 120)))) for i in range(3000)]
    rows += [(10_000 + i, "hot text " * 6) for i in range(1700)] + [(20_000 + i, f"pair {i // 3}") for i in range(300)]
    rows += [(None, "no id"), (30_000, None), (30_001, None), (30_002, ""), (30_003, "same"), (30_003, "same")]
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, size int, shard string")
    got = sharding.shard_by_bytes(docs, 24).collect()
    check_shards(rows, got, 24, 0.02)
    homes: dict = {}
    for r in got:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    hot = zlib.crc32(b"hot text " * 6)
    assert len(homes[hot]) > 5
    assert all(len(s) == 1 for c, s in homes.items() if c != hot)
    again = sharding.shard_by_bytes(docs.repartition(3), 24).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check_shards(rows, queries.op9_sampled_splitters(spark, small).collect(), 24, 0.02)


def brute(docs, shards):
    """The placement in plain Python, from the rows and Spark's hashes of them."""
    from pyspark.sql import functions as F

    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    hashed = hashed.withColumns({"luck": F.pmod(F.xxhash64("doc_id", "key", F.lit("draw")), F.lit(1 << 30)), "by_id": F.xxhash64("doc_id", F.lit("part")), "by_key": F.xxhash64("key", F.lit("part")), "apart": F.pmod(F.xxhash64("doc_id", "key"), F.lit(64))})
    rows = [r.asDict() | {"size": len((r["text"] or "").encode()) + 8} for r in hashed.collect()]
    total, groups = sum(r["size"] for r in rows), {}
    for r in rows:
        groups.setdefault(r["key"], []).append(r)
    shard = total / shards
    hot, units = [], []
    for key, own in groups.items():
        size = sum(r["size"] for r in own)
        if size * shards * sharding.LARGE_PER_SHARD < total:
            continue
        if size <= shard / 2 or len(own) == 1:
            units.append((size, key, 0, own))
        elif size / len(own) * sharding.LARGE_PER_SHARD >= shard:
            units += [(r["size"], key, i, [r]) for i, r in enumerate(sorted(own, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)))]
        else:
            hot.append(key)
    loads, placed = [0] * shards, set()
    for size, _, _, own in sorted(units, key=lambda u: u[:3], reverse=True):
        lightest = min(range(shards), key=lambda i: (loads[i], i))
        loads[lightest] += size
        for r in own:
            r |= {"shard": lightest, "cell": (-1 - r["apart"], lightest), "at": 0}
            placed.add(id(r))
    rest = [r for r in rows if id(r) not in placed]
    left, level, below = total - sum(loads), 0.0, sorted(loads)
    for k in range(1, shards + 1):
        level = (left + sum(below[:k])) / k
        if k == shards or level <= below[k]:
            break
    room = [max(level - x, 0.0) for x in loads]
    ranges = shards * sharding.RANGES_PER_SHARD
    draws: dict = {}
    for r in rest:
        n = int(r["size"] * (ranges * sharding.DRAWS_PER_RANGE / sum(room)) + r["luck"] / (1 << 30))
        if n:
            draws[r["key"]] = draws.get(r["key"], 0) + n
    bounds, seen = [], 0
    for key in sorted(draws):
        seen += draws[key]
        while len(bounds) < ranges - 1 and seen * ranges >= sum(draws.values()) * (len(bounds) + 1):
            bounds.append(key)
    bounds = sorted({*bounds, *hot, *(k - 1 for k in hot)})
    sums: dict = {}
    for r in rest:
        r["range"] = bisect.bisect_left(bounds, r["key"])
        sums[r["range"]] = sums.get(r["range"], 0) + r["size"]
    most = min(sum(room) / ranges, sharding.CELL_BYTES)
    for r in rest:
        parts = int(sums[r["range"]] / most) + 1 if sums[r["range"]] > 1.5 * most else 1
        r["cell"] = (r["range"], (r["by_id"] if r["key"] in hot else r["by_key"]) % parts)
    at, ends = 0, [sum(room[: i + 1]) for i in range(shards - 1)]
    first: dict = {}
    for r in sorted(rest, key=lambda r: (r["cell"], r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"])):
        r["at"] = at
        start = at if r["key"] in hot else first.setdefault((r["cell"], r["key"]), at)
        r["shard"] = sum(e <= start for e in ends)
        at += r["size"]
    slots = [0] * shards
    out = []
    for r in sorted(rows, key=lambda r: (r["cell"], r["at"], r["key"], r["doc_id"] is not None, r["doc_id"] or 0)):
        out.append((r["doc_id"], r["size"], r["shard"], slots[r["shard"]]))
        slots[r["shard"]] += 1
    return out


@pytest.mark.parametrize("cell", [256_000_000, 500])
def test_placement_matches_brute_force(spark, tiny, monkeypatch, cell):
    """Also where every range is subdivided, as large inputs need."""
    monkeypatch.setattr(sharding, "CELL_BYTES", cell)
    rng = random.Random(11)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 120)))) for i in range(1500)] + [(10_000 + i, "hot text " * 6) for i in range(900)] + [(20_000 + i, f"pair {i // 3}") for i in range(200)]
    rows += [(30_000 + i, "huge copies " * 400) for i in range(9)] + [(None, "no id"), (40_000, None), (40_001, "long " * 3000)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{tiny}/documents.parquet")):
        got = [(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(docs, 24).collect()]
        assert sorted(got, key=str) == sorted(brute(docs, 24), key=str)


def test_large_texts_first():
    homes, room = sharding.place_large([(100, 1, 0), (60, 2, 0), (50, 2, 1)], 300, 3)
    assert homes == [(1, 0, 0), (2, 0, 1), (2, 1, 2)] and room == [0.0, 40.0, 50.0]
    assert sharding.place_large([], 30, 3) == ([], [10.0] * 3)


def test_no_python_in_any_plan(spark, tiny, monkeypatch):
    """The plans before each checkpoint and each collect, and the one that is returned."""
    plans, cut, collect = [], sharding.textkit.cut, type(spark.range(1)).collect
    note = lambda df: plans.append(df._jdf.queryExecution().toString())
    monkeypatch.setattr(sharding.textkit, "cut", lambda df: note(df) or cut(df))
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: note(df) or collect(df))
    note(queries.op9_sampled_splitters(spark, tiny))
    assert len(plans) > 4
    assert not any(word in plan for plan in plans for word in ("Python", "Pandas", "ArrowEval", "MapInArrow", "ExternalRDD"))


def test_small_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sharding.shard_by_bytes(docs.limit(0), 24).collect() == []
    assert len(sharding.shard_by_bytes(docs, 24).collect()) == 2
    sharding.write_shards(docs, str(tmp_path / "out"), 2)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_written_shards_hold_every_row_once(spark, tmp_path):
    """Null and repeated ids, equal rows, and columns named like the operator's own."""
    rows = [(None, "no id", "a", 1), (None, "no id", "b", 2), (None, None, "c", 3), (7, "x", "d", 4), (7, "x", "e", 5), (7, "y", "f", 6), *[(i, f"text {i}", "g", i) for i in range(100, 160)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string, row_id long")
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((tuple(r[c] for c in docs.columns) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == set(range(5))
