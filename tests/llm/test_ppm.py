import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandmill.llm import ppm, textkit


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_scores(train, texts, order):
    """The same model with dictionaries and sets: log10 of the probability of each text."""
    child = {}
    for t in train:
        s = bytes([ppm.START]) * order + fold(t).encode() + bytes([ppm.END])
        for i in range(order, len(s)):
            for m in range(order + 1):
                child.setdefault(s[i - m : i], Counter())[s[i]] += 1
    out = []
    for t in texts:
        s, total = bytes([ppm.START]) * order + fold(t).encode() + bytes([ppm.END]), 0.0
        for i in range(order, len(s)):
            gone, escaped = set(), False
            for m in range(order, -1, -1):
                every = child.get(s[i - m : i], {})
                kept = {k: v for k, v in every.items() if v >= ppm.LEAST}
                if not kept and not escaped:
                    continue
                seen = {k: v for k, v in kept.items() if k not in gone}
                pruned = sum(every.values()) - sum(kept.values())
                room = sum(seen.values()) + pruned
                escaped = True
                if s[i] in seen:
                    total += math.log10((seen[s[i]] - ppm.DISCOUNT) / room)
                    break
                total += math.log10((ppm.DISCOUNT * len(seen) + pruned) / room) if room else 0.0
                gone |= set(seen)
            else:
                total += math.log10(1 / (ppm.SYMBOLS - len(gone)))
        out.append(total)
    return out


def made(n=60):
    rng = random.Random(2)
    words = ["".join(rng.choices("abCé漢.", k=rng.randint(1, 6))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60]))) for _ in range(n)]
    return [*texts, None, "", " \n", "zzz unseen", texts[7], "Long " * 12_000]


def test_scores_and_baseline_match_brute_force(spark):
    texts = made()
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(4, texts[4], 1), (None, "abc", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = ppm.report(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = [t for i, t, _ in rows if not held(i)]
    score = dict(zip([r[0] for r in rows], brute_scores(train, [r[1] for r in rows], ppm.ORDER), strict=True))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", fold(t)) + [None]
    counts = Counter(w for t in train for w in split(t))
    n, v = sum(counts.values()), len(counts)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        words = split(text[r["doc_id"]])
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(counts[w] > 0 for w in words))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert r["score"] == pytest.approx(score[r["doc_id"]], rel=1e-4)


@pytest.mark.parametrize("resolution", [1 << 22, 40])
def test_every_context_sums_to_one(spark, resolution):
    trie = ppm.train(spark.createDataFrame([(t,) for t in made()], "text string"), 3, resolution)
    for context in (b"", b"ab", b"a", b"\xc3", b"zq", b"long "):
        rows = [bytes([ppm.START]) * 3 + context + bytes([b]) for b in range(256) if b != ppm.START]
        symbols = np.frombuffer(b"".join(rows), np.uint8)
        coded = np.zeros(len(symbols), bool)
        coded[len(rows[0]) - 1 :: len(rows[0])] = True
        assert (10 ** trie.scores(symbols, coded)).sum() == pytest.approx(1, abs=1e-4)


def test_beats_the_words_on_held_out_texts(spark):
    """With enough to learn from: the baseline charges any unknown word the same, however long, which favours it on tiny tables."""
    got = [r for r in ppm.report(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.report(docs).collect() == []
    one = spark.createDataFrame([(8, "ab")], "doc_id long, text string")
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = ppm.report(one.withColumn("doc_id", one["doc_id"] * 0 + held)).first()
    assert row["score"] == pytest.approx(-3 * math.log10(ppm.SYMBOLS), rel=1e-5) and row["base_score"] == pytest.approx(0)


def test_slots_find_all_and_nothing_else():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    slots = ppm._Slots(keys)
    assert (slots.find(keys) == np.arange(len(keys))).all()
    assert (slots.find(textkit.mix(keys)) == -1).all()


def test_three_occurrences_keep_a_string_in_a_large_corpus(spark):
    """13.6 MB of one common word, in which a rare word occurs three times: it stays, as in a small corpus."""
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(i, "ab " * 200_000) for i in ids[:23]] + [(i, "qxwvkz") for i in ids[23:26]] + [(held, "qxwvkz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = next(r["score"] for r in ppm.report(docs).collect() if r["doc_id"] == held)
    assert got > -8  # each symbol after the first follows its context in all of three cases
    assert got == pytest.approx(brute_scores(["ab " * 200] + ["qxwvkz"] * 3, ["qxwvkz"], ppm.ORDER)[0], abs=1.0)


def test_one_unseen_word_repeated_40000_times(spark):
    ids = {h: [i for i in range(60) if (zlib.crc32(str(i).encode()) % 5 == 1) == h] for h in (False, True)}
    docs = spark.createDataFrame([(ids[False][0], "some words"), (ids[True][0], "junk " * 40_000), (ids[True][1], "junk " * 70_000)], "doc_id long, text string")
    n, v = 3, 3  # two words and the end
    for doc_id, times in ((ids[True][0], 40_000), (ids[True][1], 70_000)):
        got = next(r for r in ppm.report(docs).collect() if r["doc_id"] == doc_id)
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (times + 1, 1, 3)
        assert got["base_score"] == pytest.approx(times * math.log10(0.5 / (n + 0.5 * (v + 1))) + math.log10(1.5 / (n + 0.5 * (v + 1))))


def test_hot_contexts_and_many_parts_change_nothing(spark, tiny, monkeypatch):
    """Nearly every context hot and dealt by four symbols, small blocks and parts: the same scores."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = {r["doc_id"]: r for r in ppm.report(docs).collect()}
    for name, value in (("HOT_PARTS", 1e-6), ("BLOCK", 40_000), ("PART", 30_000), ("WORD_PART", 50_000)):
        monkeypatch.setattr(ppm, name, value)
    got = ppm.report(docs).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert r["score"] == pytest.approx(w["score"], rel=1e-6) and r["base_score"] == pytest.approx(w["base_score"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w["n_tokens"], w["n_known"], w["train_tokens"])


def test_hot_contexts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_PARTS", 0.02)
    test_scores_and_baseline_match_brute_force(spark)


def test_floats_round_trip():
    x = np.array([-3.5, 0.0, -1e-9, -12.25], np.float32)
    assert (ppm._floats_read(ppm._floats_packed(x), 4) == x).all() and len(ppm._floats_read(ppm._floats_packed(x[:0]), 0)) == 0
