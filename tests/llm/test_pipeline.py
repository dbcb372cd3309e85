import random
import re

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from strandmill.llm import mixing, neardedup, pieces, quality


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def families(seed=6, families=12):
    """Documents by family: changed copies that stay over 0.8 alike, and lone documents."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(3000)]
    rows, i = [], 0
    for f in range(families):
        base = rng.choices(vocabulary, k=300)
        for _ in range(rng.randint(2, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(300)] = rng.choice(vocabulary)
            rows.append((i, " ".join(own), "src", f))
            i += 1
    for f in range(40):
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 80]))), "src", 100 + f))
        i += 1
    return rows


def test_near_duplicates_keep_one_of_each_family(spark):
    rows = families()
    docs = spark.createDataFrame([(i, t, s, f) for i, t, s, f in rows], "doc_id long, text string, source string, row_key long")
    kept = {r["doc_id"] for r in neardedup.dedupe(docs).collect()}
    text, family = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    for i in text:
        if i not in kept:  # a kept document stands for each that went
            assert any(alike(text[i], text[j]) for j in kept if j < i and family[j] == family[i])
    left = sum(1 for i in kept for j in kept if i < j and alike(text[i], text[j]))
    gone = len(text) - len(kept)
    assert left <= 0.05 * gone
    assert all(i in kept for i in text if family[i] >= 100)


def test_no_pair_of_080_to_085_stays(spark):
    """Lone pairs just above the limit, against brute force."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(3000)]
    pairs = []
    while len(pairs) < 60:
        base = rng.choices(vocabulary, k=300)
        own = list(base)
        for _ in range(rng.randint(5, 7)):
            own[rng.randrange(300)] = rng.choice(vocabulary)
        a, b = shingles(" ".join(base)), shingles(" ".join(own))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs.append((" ".join(base), " ".join(own)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardedup.dedupe(docs).collect()) == list(range(0, 120, 2))


def test_repeats_within_a_text_do_not_hide_its_set(spark):
    """Nearly equal sets of shingles, of which one text repeats twenty 30 times: judged and found by set."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(3000)]
    texts = []
    for _ in range(10):
        line, rest = rng.choices(vocabulary, k=24), rng.choices(vocabulary, k=400)
        texts += [" ".join(line + rest), " ".join(line * 30 + rest)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(alike(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert sorted(r["doc_id"] for r in neardedup.dedupe(docs).collect()) == list(range(0, 20, 2))


def test_unlike_documents_in_one_group_settle_in_few_rounds(spark, monkeypatch):
    """Documents that are linked, as pairs of similarity 1/2 often share a key, but all stay; a round settles as many as a task takes."""
    rounds, settle = [], neardedup.textkit.small
    monkeypatch.setattr(neardedup.textkit, "small", lambda t: rounds.append("shares" in t.columns) or settle(t))
    monkeypatch.setattr(neardedup, "TASK_BYTES", 400 * 300 * 8)
    docs = spark.createDataFrame([(i, " ".join([*(f"u{i}_{j}" for j in range(100)), *(f"w{j}" for j in range(200))])) for i in range(1000)], "doc_id long, text string").repartition(8)
    again = docs.where("doc_id % 100 = 3").withColumn("doc_id", docs["doc_id"] + 5000)
    assert {r["doc_id"] for r in neardedup.dedupe(docs.unionByName(again)).collect()} == set(range(1000))
    assert 1 <= sum(rounds) <= 3


def test_large_groups_settle_in_rounds(spark, monkeypatch):
    rows = families(9, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    want = sorted(r["doc_id"] for r in neardedup.dedupe(docs).collect())
    monkeypatch.setattr(neardedup, "TASK_GROUP", 2)
    assert sorted(r["doc_id"] for r in neardedup.dedupe(docs).collect()) == want


def test_near_duplicates_cases(spark):
    rows = [(5, "One two three four five six"), (3, "one  TWO three four five\tsix"), (7, None), (6, ""), (None, "one two three four five six"), (9, "other words"), (9, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardedup.dedupe(docs).collect()) == [3, 6, 9]
    assert neardedup.dedupe(docs.limit(0)).collect() == []


def test_stages_on_their_own_input(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, tiny)
        after = spark.createDataFrame(after.collect(), after.schema)
        old, new = before.collect(), after.collect()
        assert len(new) > 0
        if name != "pieces":
            assert after.columns == columns
        if name == "quality":
            weights = quality.fitted(spark, before, spark.read.parquet(f"{tiny}/labels.parquet"))
            good = {r["doc_id"] for r in quality.score(before, weights).collect() if r["score"] >= quality.THRESHOLD}
            assert sorted(r["doc_id"] for r in new) == sorted(good) and len(good) < len(old)
        if name == "near_duplicates":
            text = {r["doc_id"]: r["text"] for r in old}
            kept = {r["doc_id"] for r in new}
            assert all(any(alike(text[i], text[j]) for j in kept) for i in text if i not in kept)
        if name == "repeated_passages":
            windows: dict = {}
            for r in old:
                words = r["text"].split()
                for k in range(len(words) - 34):
                    windows[tuple(words[k : k + 35])] = windows.get(tuple(words[k : k + 35]), 0) + 1
            for r in old:
                words, gone = r["text"].split(), set()
                for k in range(len(words) - 34):
                    if windows[tuple(words[k : k + 35])] > 1:
                        gone.update(range(k, k + 35))
                own = next(x for x in new if x["doc_id"] == r["doc_id"])
                assert own["text"].split() == [w for k, w in enumerate(words) if k not in gone]
                assert gone or own["text"] == r["text"]
        if name == "source_mix":
            want = {r["doc_id"]: r["copies"] for r in mixing.copies(before).collect()}
            got: dict = {}
            for r in new:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {k: v for k, v in want.items() if v}
        if name == "pieces":
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            text = {r["doc_id"]: r["text"] for r in old}
            assert len(new) == len(old) and all(r["ids"] == library.encode(text[r["doc_id"]]) for r in new)
        before = after


CLASHING = ["row", "c0", "row_key", "row_key2", "node", "bands", "key", "root", "shingles", "home", "first_home", "size", "n", "copies", "drawn", "copy", "same", "own", "before", "score", "quality_score", "block", "part", "target", "state", "share"]


def test_clashing_columns_keep_their_values_in_every_stage(spark, tiny):
    """Columns named like the operators' own come back unchanged, row by row."""
    plain = spark.read.parquet(f"{tiny}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tiny)
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows
        for r in rows:
            assert [r[c] for c in CLASHING] == [f"{c} of {r['doc_id']}" for c in CLASHING], name
        docs = spark.createDataFrame(rows, docs.schema)


def test_repeated_rows_are_drawn_as_separate_rows(spark, monkeypatch):
    """Rows equal in id, text and source: as many copies in all as their number and the share ask for."""
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(1, "a b c", "s", "x")] * 40 + [(i, "one two", "s", "y") for i in range(2, 20)] + [(50, "other words here", "t", "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string").repartition(5)
    placed = mixing.copies(docs).collect()
    assert len(placed) == len(rows)
    want: dict = {}
    for r in placed:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    got: dict = {}
    for r in mixing.mix(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_pieces"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_simhash_links_propose_near_duplicates(spark, monkeypatch):
    """With the minhash keys made useless, what op10's fingerprints link is found all the same, and judged by set."""
    real = neardedup.band_keys
    monkeypatch.setattr(neardedup, "band_keys", lambda hashes, first: real(hashes, first) * 0 + neardedup.textkit.mix(neardedup.textkit.range_hash(hashes, first[:-1], first[1:]))[:, None])
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(3000)]
    texts = []
    for _ in range(10):
        base = rng.choices(vocabulary, k=600)
        texts += [" ".join(base), " ".join([*base[:-1], "zzz"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = {r["doc_id"]: r["component_id"] for r in neardedup.simhash.linked(docs).collect()}
    want = [i for i in range(20) if i % 2 == 0 or linked[i] == i]
    assert len(want) < 20 and sorted(r["doc_id"] for r in neardedup.dedupe(docs).collect()) == want
