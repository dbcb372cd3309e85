import hashlib
import random
import re
from collections import Counter

import numpy as np

from strandmill.llm import substring, textkit


def brute(rows, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    times = Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if times[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def made(n=120):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abé漢", k=rng.randint(1, 5))) for _ in range(300)]
    passages = [rng.choices(vocabulary, k=rng.randint(20, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 34, 35, 36, 200]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    loop = "x y " * 60
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, loop), (None, rows[4][1]), (n + 4, "w" + " longword" * 20_000)]


def test_matches_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, part int, target string")
    got = sorted((tuple(r) for r in substring.report(docs, 35).collect()), key=str)
    assert got == brute(rows, 35)


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substring.report(docs, 35).collect()), key=str) == brute(rows, 35)


def test_small_sketch_loses_nothing(spark, monkeypatch):
    """Nine bits of cells for thousands of windows, and many blocks, slices and targets: all windows are candidates, and the result is exact."""
    for name, value in (("CELLS_A_BYTE", 0.001), ("LEAST_BITS", 9), ("SLICE_BITS", 3), ("BLOCK", 3_000), ("TARGET", 5_000)):
        monkeypatch.setattr(substring, name, value)
    rows = made(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring.report(docs, 35).collect()), key=str) == brute(rows, 35)


def test_rows_repeated_many_times(spark):
    rows = [(1, "a b c " * 20)] * 500 + [(2, " ".join(f"w{i}" for i in range(60)))] * 3 + [(3, "alone " + " ".join(f"v{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in substring.report(docs, 35).collect()), key=str) == brute(rows, 35)


def test_texts_move_once(spark, tiny):
    """All three passes read one exchange of the texts."""
    report = substring.report(spark.read.parquet(f"{tiny}/documents.parquet"), 35)
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 1 and final.count("ReusedExchange") == 2


def test_cells_round_trip():
    rng = random.Random(1)
    for n, limit in ((0, 100), (1, 1), (5, 10), (300, 1 << 12), (300, 1 << 18), (40, 1 << 24), (3, 1 << 30)):
        values = np.array(sorted(rng.sample(range(limit), n)), np.int64)
        blob = textkit.ascending_packed(values, limit)
        assert textkit.ascending_read(blob).tolist() == values.tolist()


CLASHING = ["row", "c0", "c1", "row_key", "row_key2", "block", "slice", "target", "bits", "mask", "cells", "h1", "h2", "alone", "part", "keys", "copy", "key"]


def test_clashing_columns_keep_their_values(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"own{i} {passage}" if i % 2 else "short", *[f"{c}{i}" for c in CLASHING]) for i in range(20)], ["doc_id", "text", *CLASHING])
    out = substring.remove(docs, 35)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r["text"] == (f"own{r['doc_id']} " if r["doc_id"] % 2 else "short")
        assert [r[c] for c in CLASHING] == [f"{c}{r['doc_id']}" for c in CLASHING]


def test_remove_keeps_the_rest(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"one\ntwo  {passage}\nthree", "a", 0), (2, f"{passage} tail", "b", 0), (3, "  untouched  text\n", "c", 18), (4, passage, None, 0), (5, None, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["source"], r["n_chars"]) for r in substring.remove(docs, 35).collect()}
    assert got == {1: ("one\ntwo  three", "a", 14), 2: ("tail", "b", 4), 3: ("  untouched  text\n", "c", 18), 4: ("", None, 0), 5: (None, "d", None)}
    assert substring.remove(docs.limit(0), 35).collect() == []


def test_query_equals_its_sql(spark, tiny):
    import duckdb

    from strandmill.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tiny}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op4_countmin_windows"]).fetchall()
    got = queries.op4_countmin_windows(spark, tiny).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r[2] for r in want)
