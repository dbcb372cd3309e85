import math
import zlib
from collections import Counter

import numpy as np
import plain
import pytest

from strandmill.llm import quality, toxicity
from strandmill.llm.features import fold


def cases(spark):
    rows = [(1, "good plain words here", "x", 0.5), (2, None, "x", 0.5), (3, "", None, 0.5), (4, " \n\t ", "x", None), (5, "BAD!! WORDS!! ||| ###", "x", 0.5), (5, "BAD!! WORDS!! ||| ###", "x", 0.5), (None, "no id", "x", 0.5), (7, "word " * 30_000, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (7, None, None), (None, 1, 0), (99, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module,n,left_out", [(quality, 4, 2), (toxicity, 3, 1)])
def test_contract_and_cases(spark, module, n, left_out):
    docs, labels = cases(spark)
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % n == left_out)
    same = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]
    assert module.classify(docs.limit(0), labels).collect() == []
    unlabelled = module.classify(docs, labels.limit(0)).collect()
    assert all(r["score"] == pytest.approx(0.5 if module is quality else 0.0, abs=1e-9) for r in unlabelled)


@pytest.mark.parametrize("module,target,good,bad", [(quality, "quality", 0.99, 0.15), (toxicity, "toxic", 0.7, 0.01)])
def test_held_out_accuracy(spark, module, target, good, bad):
    """Share of label 1 and of label 0 predicted as 1, on rows whose labels were never seen."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in module.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect() if r["held_out"] and r["doc_id"] in labels]
    rate = lambda label: np.mean([r["predicted"] for r in got if labels[r["doc_id"]] == label])
    assert rate(1) >= good and rate(0) <= bad


def test_held_out_labels_do_not_matter(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    from pyspark.sql import functions as F

    for module, target, n, left_out in ((quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)):
        turned = labels.withColumn(target, F.when(fold("doc_id", n) == left_out, 1 - F.col(target)).otherwise(F.col(target)))
        a = sorted((r["doc_id"], r["score"]) for r in module.classify(docs, labels).collect())
        assert a == sorted((r["doc_id"], r["score"]) for r in module.classify(docs, turned).collect())


def test_offending_sentences(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, f"Calm words number w{i} go here. {'You vileword person.' if bad else 'A kind remark.'} More w{i} text follows.\nAnd a last line w{i % 7}"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = docs.join(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id").selectExpr("text", "toxic target", "xxhash64(doc_id) luck")
    weights = toxicity.train(sample)
    found = toxicity.offending(docs, weights).collect()
    assert {r["doc_id"] for r in found} == {i for i in range(0, 240, 4)}
    assert all(r["sentence"] == "You vileword person." for r in found)
    for r in toxicity.score(docs, weights).collect():
        if r["doc_id"] % 4 == 0:
            text = dict(rows)[r["doc_id"]].encode()
            assert text[r["worst_at"] : r["worst_at"] + r["worst_bytes"]] == b"You vileword person."


def test_leader_updates_follow_the_closed_form():
    """With one feature the weight is the minimiser of the regularised leader's objective."""
    model = quality.Ftrl(1)
    at, x = np.array([0]), np.array([1.0])
    for y in (1, 1, 0, 1):
        model.learn(at, x, y)
    z, n = model.z[0], model.n[0]
    grid = np.linspace(-5, 5, 200_001)
    objective = z * grid + 0.5 * ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2) * grid**2 + quality.L1 * np.abs(grid)
    assert model.weights(at)[0] == pytest.approx(grid[np.argmin(objective)], abs=1e-4)


# Brute-force versions: dictionaries instead of arrays, one feature at a time, hashes in plain integers.


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35, min(35, x))))


def shape(raw):
    kinds = ["a" if 0x61 <= b <= 0x7A or b >= 0x80 else "A" if 0x41 <= b <= 0x5A else "0" if 0x30 <= b <= 0x39 else chr(b) for b in raw]
    return [k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]]


def grams(text, bits):
    out, word, form = [], 1, 2
    for _, _, raw in plain.words(text):
        before, before_form = word, form
        word = plain.byte_hash(plain.lowered(raw))
        form = plain.sequence_hash([plain.mix(ord(k) + 7) for k in shape(raw)])
        out += [plain.mix(word + 11), plain.mix(word + before * 3), plain.mix(form + 13), plain.mix(form + before_form * 5)]
    return [h >> (64 - bits) for h in out]


def brute_quality(texts, sample):
    bits, z, n = quality.BITS, {}, {}

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= quality.L1 else -(a - math.copysign(quality.L1, a)) / ((quality.BETA + math.sqrt(n.get(k, 0.0))) / quality.ALPHA + quality.L2)

    def features(text):
        found = grams(text, bits)
        return {k: c * quality.SCALE / len(found) for k, c in Counter(found).items()} | {"bias": 1.0}

    rows = [(features(t), y) for t, y in sample]
    for _ in range(quality.EPOCHS):
        for x, y in rows:
            p = sigmoid(sum(weight(k) * v for k, v in x.items()))
            for k, v in x.items():
                w, g = weight(k), (p - y) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / quality.ALPHA * w
                n[k] = n.get(k, 0.0) + g * g
    return [sigmoid(sum(weight(k) * v for k, v in features(t).items())) for t in texts]


def sentence_sets(text, bits):
    out, current, raw_text = [], set(), (text or "").encode()
    found = plain.words(text)
    for i, (start, end, raw) in enumerate(found):
        bare = plain.lowered(raw)
        for _ in range(4):
            if bare and 0x21 <= bare[0] < 0x80 and not chr(bare[0]).isalnum():
                bare = bare[1:]
            if bare and 0x21 <= bare[-1] < 0x80 and not chr(bare[-1]).isalnum():
                bare = bare[:-1]
        current.add(plain.mix(plain.byte_hash(bare) + 1) >> (64 - bits))
        current |= {plain.mix(plain.byte_hash(bare[:k]) + 100 + k) >> (64 - bits) for k in toxicity.PREFIXES if len(bare) >= k}
        if raw[-1:] in (b".", b"!", b"?") or i + 1 == len(found) or b"\n" in raw_text[end : found[i + 1][0]]:
            out.append(current)
            current = set()
    return out


def brute_toxicity(texts, sample):
    bits = toxicity.BITS
    rows = [(s, y) for s, y in ((sentence_sets(t, bits), y) for t, y in sample) if s]
    seen = Counter(k for s, _ in rows for k in set().union(*s))
    rows = [([{k for k in one if seen[k] >= toxicity.LEAST_DOCS} for one in s], y) for s, y in rows]
    z, n, bias, squares = {}, {}, toxicity.BIAS, 1.0

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= toxicity.L1 else (a - math.copysign(toxicity.L1, a)) / ((1 + math.sqrt(n.get(k, 0.0))) / toxicity.RATE + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for s, y in rows:
            if not any(s):
                continue
            # A sentence without features left at the text's end is not seen.
            while not s[-1]:
                s = s[:-1]
            p = [sigmoid(sum(map(weight, one)) + bias) for one in s]
            none = math.exp(sum(math.log1p(-min(x, 1 - 1e-12)) for x in p))
            slope = [x * none / max(1 - none, 1e-9) if y else -x for x in p]
            g = Counter()
            for one, v in zip(s, slope, strict=True):
                for k in one:
                    g[k] += v
            old = {k: weight(k) for k in g}
            for k, v in g.items():
                z[k] = z.get(k, 0.0) + v + (math.sqrt(n.get(k, 0.0) + v * v) - math.sqrt(n.get(k, 0.0))) / toxicity.RATE * old[k]
                n[k] = n.get(k, 0.0) + v * v
            total = sum(slope)
            squares += total * total
            bias = min(bias + 0.05 * total / math.sqrt(squares), -5.0)
        rows = [([{k for k in one if abs(z.get(k, 0.0)) > toxicity.L1 / 4} for one in s], y) for s, y in rows]
    out = []
    for t in texts:
        clear = sum(math.log1p(-min(sigmoid(sum(map(weight, one)) + bias), 1 - 1e-12)) for one in sentence_sets(t, bits))
        out.append(-math.expm1(clear))
    return out


@pytest.mark.parametrize("module,target,n,left_out,brute", [(quality, "quality", 4, 2, brute_quality), (toxicity, "toxic", 3, 1, brute_toxicity)])
def test_scores_match_brute_force(spark, module, target, n, left_out, brute):
    """The query's own path, from labels to scores, on texts of several languages, odd ones among them."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(90).select("doc_id", "text")
    odd = spark.createDataFrame([(1_000_000 + i, t) for i, t in enumerate(["", None, "One. Two! three\nfour?\n\n(five)", "É ÀB 9-9 !!", "x" * 400, ". . ."])], docs.schema)
    docs = docs.union(odd)
    rows = sorted(docs.collect())
    labels = spark.createDataFrame([(r["doc_id"], int(len(r["text"] or "") % 3 > 0), int("e" in (r["text"] or "")[:9])) for r in rows], "doc_id long, quality int, toxic int")
    label = {r["doc_id"]: r[target] for r in labels.collect()}
    luck = {r["doc_id"]: r["luck"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("train")).alias("luck")).collect()}
    chosen = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % n != left_out]
    sample = [(r["text"], label[r["doc_id"]]) for r in sorted(chosen, key=lambda r: luck[r["doc_id"]])]
    want = brute([r["text"] for r in rows], sample)
    got = {r["doc_id"]: r["score"] for r in module.classify(docs, labels).collect()}
    assert [got[r["doc_id"]] for r in rows] == pytest.approx(want, abs=2e-4)
    assert max(want) - min(want) > 0.05


def test_the_sample_is_bounded_after_the_join(spark):
    """An id that many rows share, equal rows, and very long texts."""
    from strandmill.llm.features import labelled_sample

    rows = [(1, f"text {i} of one id") for i in range(5000)] + [(2, "twice")] * 2 + [(i, f"short {i}") for i in range(3, 60)] + [(60, "w " * 10_000_000), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 62)], "doc_id long, quality int")
    whole = labelled_sample(docs, labels, "quality", 4, 2, 10**6).collect()
    assert len(whole) > 5000 and sum(r["text"] == "twice" for r in whole) <= 1 and max(len(r["text"] or "") for r in whole) < 100
    for most in (1, 10, 300):
        few = labelled_sample(docs, labels, "quality", 4, 2, most).collect()
        assert 0 < len(few) <= most
        assert sorted(few) == sorted(labelled_sample(docs.repartition(3), labels, "quality", 4, 2, most).collect())
    assert sum(len(r["text"]) for r in labelled_sample(docs, labels, "quality", 4, 2, 10**6, most_bytes=2000).collect()) <= 2000
