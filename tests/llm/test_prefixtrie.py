import hashlib
import random
import zlib

import duckdb
import pytest

from strandmill.llm import prefixtrie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = turns.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in own) if own else 1
        saved[node] = sum(saved[k] for k in own) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (
            (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
            for node, m in members.items()
        ),
        key=str,
    )


def made(seed=1, n=150):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-6, 400), n):
        for turn in range(rng.choice([1, 2, 5, 12])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["hi", "ho é", "", None])))
    one = [(0, i, "user", "hi") for i in range(9)]
    copies = [(c, i, "bot", "same " * i) for c in range(1000, 1100) for i in range(3)]  # a group of equal ones
    rows += one + copies + rows[:20] + [(None, 1, "user", "nobody"), (2000, 1, "a", "x" * 5000)]
    rng.shuffle(rows)
    return rows


def mine(df):
    return sorted((tuple(r) for r in prefixtrie.nodes(df).select(*COLUMNS).collect()), key=str)


KINDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [16, 1])
def test_nodes_equal_brute_force(spark, monkeypatch, block):
    """Also with blocks of two turns, so that all results carry over block boundaries."""
    monkeypatch.setattr(prefixtrie, "BLOCK_SHIFT", block)
    monkeypatch.setattr(prefixtrie, "CHUNK", 50)
    rows = made()
    df = spark.createDataFrame([(*r, 1) for r in rows], KINDS + ", depth int").repartition(5)
    assert mine(df) == brute(rows)
    assert mine(df.limit(0)) == []


def test_parents_with_many_children(spark, monkeypatch):
    rows = [(c, t, "user", "first" if t == 0 else f"{c}") for c in range(300) for t in range(2)]
    df = spark.createDataFrame(rows, KINDS)
    for hot in (8, 0, 10**6):
        monkeypatch.setattr(prefixtrie, "HOT", hot)
        assert mine(df) == brute(rows)


def test_one_long_conversation(spark):
    rows = [(7, i, "user", f"t{i % 3}") for i in range(3000)] + [(8, 0, "bot", "x"), (5, 0, "user", "t0")]
    assert mine(spark.createDataFrame(rows, KINDS)) == brute(rows)


def test_query_equals_its_sql_and_brute_force(spark, tiny):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tiny}/conversations.parquet'")
    want = sorted(con.execute(f"select {', '.join(COLUMNS)} from ({queries.oracle_sql()['op13_prefix_ownership']})").fetchall(), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_prefix_ownership(spark, tiny).select(*COLUMNS).collect()), key=str)
    assert got == want == brute(rows) and any(r[3] > 2 and r[1] for r in got)


def test_sql_equals_brute_force():
    rows = made(2, 60)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = con.execute(f"select {', '.join(COLUMNS)} from ({queries.oracle_sql()['op13_prefix_ownership']})").fetchall()
    assert sorted(got, key=str) == brute(rows)
