from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galeledger.llm import language_id, quality

SF = "/root/testdata/sf0.01"


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_rows(table):
    rows = [(i, "") for i in range(50)] + [(None, "")]
    got = table(rows).select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == out(r.doc_id) for r in got)


def code_length(text, trained):
    """Bits of a text after the counts of the texts ``trained``, byte by byte."""
    fold = lambda t: bytes(
        32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in t.encode()
    )
    seen = defaultdict(Counter)
    for t in trained:
        data = b"   " + fold(t)
        for k in range(3, len(data)):
            for n in range(4):
                seen[data[k - n : k]][data[k]] += 1
    total = 0.0
    data = b"   " + fold(text)
    for k in range(3, len(data)):
        for n in (3, 2, 1, 0):
            own = seen.get(data[k - n : k])
            if own is None:
                continue
            whole = sum(own.values()) + len(own)
            if data[k] in own:
                total -= math.log2(own[data[k]] / whole)
                break
            total -= math.log2(len(own) / whole)
        else:
            total += 8
    return total


def test_code_lengths_equal_brute_force(table):
    rnd = random.Random(4)
    texts = {"xx": [], "yy": []}
    for lang, letters in (("xx", "abc dé"), ("yy", "abz ñ")):
        for _ in range(6):
            texts[lang].append("".join(rnd.choice(letters) for _ in range(80)))
    rows = [(k, t, lang) for lang in texts for k, t in enumerate(texts[lang])]
    (trees,) = language_id.learn(table(rows, "doc_id long, text string, lang string"))
    tests = ["abc abd", "", "zz\nñ é", "QQQ ab", "a", "abcabc dd zz"]
    got = trees.lengths(pa.array(tests))
    for row, text in enumerate(tests):
        for column, lang in enumerate(trees.langs):
            assert got[row, column] == pytest.approx(code_length(text, texts[lang]), rel=1e-5, abs=1e-4)


def test_languages_of_few_long_texts_are_learned(table):
    """Each text alone is longer than the sample; one at least is learned."""
    rows = [(i + 100 * k, f"{word} " * 600, word) for k, word in enumerate(["abc", "déf", "xyz"]) for i in range(4)]
    docs = table(rows, "doc_id long, text string, lang string")
    chosen = Counter(r.lang for r in language_id.sample(docs, 500).collect())
    assert set(chosen) == {"abc", "déf", "xyz"}
    got = language_id.predict_languages(docs, sample_bytes=500).collect()
    assert all(r.lang_pred == rows[[x[0] for x in rows].index(r.doc_id)][2] for r in got)


def test_sample_is_whole_texts_until_the_bound(table):
    rows = [(i, "x" * 90 + "é" * 5, "long") for i in range(3000)] + [(i, "y", "short") for i in range(7)]
    rows += [(9, None, "none"), (10, "", "none")]
    chosen = language_id.sample(table(rows, "doc_id long, text string, lang string"), 20_000).collect()
    sizes = Counter()
    for r in chosen:
        sizes[r.lang] += len(r.text.encode())
    assert 20_000 <= sizes["long"] <= 26_000 and sizes["short"] == 7 and "none" not in sizes


def test_many_languages(table):
    """More languages than a block holds: costs are those of all at once."""
    rnd = random.Random(7)
    names = [f"l{i:04d}" for i in range(1500)]
    rows = [(k, f"{name} {name[1:]} " + "".join(rnd.choice("abcdef ") for _ in range(12)), name) for k, name in enumerate(names)]
    docs = table(rows, "doc_id long, text string, lang string")
    blocks = language_id.learn(docs)
    assert [x for t in blocks for x in t.langs] == names and max(len(t.langs) for t in blocks) == language_id.BLOCK
    few = table(rows[:70], "doc_id long, text string, lang string")
    one, two = language_id.learn(few, block=100), language_id.learn(few, block=9)
    texts = pa.array([r[1] for r in rows[:90]])
    assert np.allclose(one[0].lengths(texts), np.concatenate([t.lengths(texts) for t in two], axis=1))
    found, score = language_id.predict(blocks, pa.array([r[1] for r in rows[:200]]))
    assert sum(found == np.array(names[:200], object)) > 190 and ((score > 0) & (score <= 1)).all()


def test_languages_of_odd_rows(table, odd_rows):
    rows = [(i, t, None) for i, t in odd_rows] + [(50, "123 !?", "en"), (51, "der die das", "de")]
    docs = table(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict_languages(docs).collect()}
    assert {r[0] for r in got if r[1] == "und"} >= {2, 3, 4, 50}
    assert all(s == 0 for _, lang, s in got if lang == "und")
    assert all(0 <= s <= 1 for _, _, s in got)
    none = language_id.predict_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.predict_languages(docs.limit(0)).collect() == []


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.predict_languages(docs).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in got) > 0.99 * len(got) > 0


def test_held_out_languages_are_not_learned_from(table):
    rows = [(i, "abc abc abc", "ab") for i in range(40)]
    rows = [(i, "xyz xyz xyz", "xy") if out(i) else r for r in rows for i in [r[0]]]
    got = language_id.predict_languages(table(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"ab"}


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.score_quality(docs, labels).collect() if r.held_out and r.doc_id in known]
    right = sum((known[r.doc_id] == 1) == (r.predicted == 1) for r in rows)
    assert right > 0.93 * len(rows) > 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_of_odd_rows(table, odd_rows):
    docs = table(odd_rows).withColumn("label", F.lit("x")).withColumn("score", F.lit(3))
    labels = table([(1, 1), (2, None), (None, 0), (5, 0), (5, 1), (6, 0), (6, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).collect() == []
    one = quality.score_quality(docs, labels.filter("quality = 1"))
    assert len({r.score for r in one.collect()}) == 1


def plain_features(text):
    """Words, runs of words and character n-grams of a text, with their counts."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
    out = Counter()
    for n in range(1, quality.WORDS + 1):
        out.update(("w", *words[k : k + n]) for k in range(len(words) - n + 1))
    for word in words:
        bounded = b" " + word + b" "
        for n in (3, 4):
            out.update(("c", bounded[k : k + n]) for k in range(len(bounded) - n + 1))
    return out


def test_features_equal_the_plain_ones():
    texts = ["a bc def a bc", "", "was was was was was was", "é\tü ñandú", " x ", "lone", "a b"]
    keys, text, n = quality._features(pa.array(texts))
    assert n == len(texts)
    buckets = {}
    for row, one in enumerate(texts):
        found = Counter(keys[text == row].tolist())
        # Alone, a text has the same buckets as in a batch.
        assert found == Counter(quality._features(pa.array([one]))[0].tolist())
        plain = plain_features(one)
        assert sorted(found.values()) == sorted(plain.values())
        for word in {f[1] for f in plain if f[0] == "w" and len(f) == 2}:
            buckets.setdefault(word, set()).update(quality._features(pa.array([word.decode()]))[0].tolist())
    # A word's own buckets are among those of each text that holds it.
    for row, one in enumerate(texts):
        for word in one.split():
            assert buckets[word.encode()] <= set(keys[text == row].tolist())


def test_one_step_of_descent_equals_the_plain_one(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    monkeypatch.setattr(quality, "BUCKETS", 8)
    keys = [np.array([1, 5]), np.array([2, 5, 7])]
    counts = [np.array([3, 1], np.float32), np.array([1, 1, 2], np.float32)]
    labels = np.array([1, 0])
    worth, bias = quality.descend(keys, counts, labels, seed=6)

    rng = np.random.Generator(np.random.PCG64(6))
    size = quality.DIMENSIONS
    vectors = rng.uniform(-1 / size, 1 / size, (8, size)).astype(np.float32).astype(float)
    layer, b = np.zeros((2, size)), np.zeros(2)
    for step, i in enumerate(rng.permutation(2)):
        rate = quality.RATE * (1 - step / 2)
        share = counts[i] / counts[i].sum()
        mean = sum(share[j] * vectors[k] for j, k in enumerate(keys[i]))
        power = np.exp(layer @ mean + b)
        error = power / power.sum() - np.eye(2)[labels[i]]
        toward = error @ layer
        for j, k in enumerate(keys[i]):
            vectors[k] = vectors[k] - rate * 0.1 * math.sqrt(share[j]) * toward
        layer = layer - rate * 0.1 * np.outer(error, mean)
        b = b - rate * 0.001 * error
    assert np.allclose(worth, vectors @ (layer[1] - layer[0]), atol=1e-4)
    assert bias == pytest.approx(b[1] - b[0], abs=1e-5)


def test_score_is_the_softmax_of_the_average():
    worth = np.random.default_rng(2).normal(size=quality.BUCKETS).astype(np.float32)
    for text in ("a bc def a", "was was was", "é ü x"):
        keys, _, _ = quality._features(pa.array([text]))
        logit = 0.3 + worth[keys].astype(float).mean()
        assert quality._scores(pa.array([text]), worth, 0.3)[0] == pytest.approx(1 / (1 + math.exp(-logit)))


def test_held_out_quality_is_ranked_well(spark):
    """Measured on the held-out rows: the share of pairs of a good and a bad text in order."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.score_quality(docs, labels).collect() if r.held_out and r.doc_id in known]
    good = np.sort([r.score for r in rows if known[r.doc_id] == 1])
    bad = [r.score for r in rows if known[r.doc_id] == 0]
    assert np.mean(1 - np.searchsorted(good, bad) / len(good)) > 0.92
    assert np.mean(good >= quality.THRESHOLD) > 0.99


def test_score_does_not_depend_on_the_batch():
    worth = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    texts = ["a bc def", "", "was was was", "é ü"]
    together = quality._scores(pa.array(texts), worth, 0.5)
    single = [quality._scores(pa.array([t]), worth, 0.5)[0] for t in texts]
    assert np.allclose(together, single, rtol=1e-12)
    assert together[1] == pytest.approx(1 / (1 + math.exp(-0.5)))
