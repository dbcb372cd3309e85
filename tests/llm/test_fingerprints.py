import hashlib
import random

import numpy as np
import plain
import pyarrow as pa

from strandmill.llm import fingerprints, textkit


def digest_sets(texts):
    data, offsets = textkit.byte_view(pa.array(texts))
    digests, first = fingerprints.paragraph_digests(data, offsets)
    return [set(digests[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)], (digests, first)


def made(n=80):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcé漢", k=rng.randint(1, 8))) for _ in range(200)]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [*texts, "same\nsame\nsame", "x", "", " \n ", texts[3], "long " * 9000, texts[3]]


def test_peeling_recovers_the_difference():
    texts = made()
    sets, (digests, first) = digest_sets(texts)
    shifted, (other, other_first) = digest_sets(texts[1:] + texts[:1])
    want = [len(a ^ b) for a, b in zip(sets, shifted, strict=True)]
    assert fingerprints.differences((digests, first), (other, other_first)).tolist() == want
    a, b = fingerprints.Sketches(digests, first, 3000), fingerprints.Sketches(other, other_first, 3000)
    done, row, digest, sign = fingerprints.peel(a.count - b.count, a.key ^ b.key, a.check ^ b.check, 3000)
    for r in np.flatnonzero(done):
        assert set(digest[(row == r) & (sign > 0)].tolist()) == sets[r] - shifted[r]
        assert set(digest[(row == r) & (sign < 0)].tolist()) == shifted[r] - sets[r]


def test_retries_until_it_peels(monkeypatch):
    """From sketches of three cells up to any size: the digests themselves are never compared."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (5, 400, 60_000)]
    sets, (digests, first) = digest_sets(texts)
    others, (other, other_first) = digest_sets([t.replace("w1", "v1") for t in texts])
    want = [len(a ^ b) for a, b in zip(sets, others, strict=True)]
    assert fingerprints.differences((digests, first), (other, other_first), 3).tolist() == want and want[2] > 5_000


def test_a_false_check_ends():
    """A digest in one of its three cells only: taking it out leaves it in the two others, again and again."""
    digest = np.array([12345], dtype=np.uint64)
    count, key, sum_ = np.zeros(60, np.int64), np.zeros(60, np.uint64), np.zeros(60, np.uint64)
    at = fingerprints.places(digest, 30)[0, 0]
    count[at], key[at], sum_[at] = 1, digest[0], fingerprints.check(digest)[0]
    done, *_ = fingerprints.peel(count, key, sum_, 30)
    assert done.tolist() == [False, True]


def plain_paragraphs(text):
    """The paragraphs of a text as (bytes, occurrence), cut by line and after words whose hash is 0 modulo CUT; nothing of the module is used."""
    raw, out, seen = (text or "").encode(), set(), {}
    found, begin = plain.words(text), None
    for i, (start, end, word) in enumerate(found):
        begin = start if begin is None else begin
        if plain.byte_hash(word) % 4 == 0 or i + 1 == len(found) or b"\n" in raw[end : found[i + 1][0]]:
            own = raw[begin:end]
            out.add((own, seen.get(own, 0)))
            seen[own] = seen.get(own, 0) + 1
            begin = None
    return out


def test_digests_stand_for_plain_paragraphs():
    texts = made()
    sets, _ = digest_sets(texts)
    assert [len(s) for s in sets] == [len(plain_paragraphs(t)) for t in texts]
    assert [len(a & b) for a, b in zip(sets, sets[1:], strict=False)] == [len(plain_paragraphs(a) & plain_paragraphs(b)) for a, b in zip(texts, texts[1:], strict=False)]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = {}
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        a, e, f = map(plain_paragraphs, (text, new, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), like(a, e), like(a, f))
    return out


def compare(spark, docs, rows):
    got = fingerprints.report(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, near, following = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - near) < 1e-12 and abs(r["near_next"] - following) < 1e-12
    return {r["doc_id"]: r for r in got}


def test_report_matches_brute_force(spark):
    rows = [(i * 7 - 50, t) for i, t in enumerate(made())] + [(None, "no id"), (10_000, None)]
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, place string, own boolean")
    got = compare(spark, docs.repartition(5), rows)
    same = [i for i, t in rows if t == rows[3][1]]
    assert len(same) == 3 and len({got[i]["fingerprint"] for i in same}) == 1


def test_few_ranges_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "MOST_RANGES", 2)
    monkeypatch.setattr(fingerprints, "CHUNK_BYTES", 200)
    rows = [(i // 2, t) for i, t in enumerate(sorted({t for t in made() if len(t) < 4000}))]
    got = fingerprints.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got) == sorted((i, len(t)) for i, t in rows)


def test_whole_table_and_small_ones(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    compare(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    one = docs.limit(1)
    assert fingerprints.report(one).first()["near_next"] == 1.0
    assert fingerprints.report(docs.limit(0)).collect() == []
