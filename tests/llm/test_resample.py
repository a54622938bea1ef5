"""Importance resampling against plain versions of its parts and of the whole."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from galeledger.llm import resample

LAST = (1 << 63) - 1


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, targets, buckets=10_000, percent=10, min_words=20, seed=2024):
    """Rows ``(doc_id, n_features, weight, score, rank)``."""
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s = Counter(bucket(w) for _, text in rows for w in brute_words(text))
    t = Counter(bucket(w) for text in targets for w in brute_words(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))
    )
    scored = []
    for doc_id, text in rows:
        found = [gain(bucket(w)) for w in brute_words(text)]
        weight = sum(found) // len(found) if found else 0
        key = LAST if doc_id is None else doc_id
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, len(found), weight, weight + noise))
    able = [i for i, r in enumerate(scored) if r[1] >= min_words]
    able.sort(key=lambda i: (-scored[i][3], LAST if scored[i][0] is None else scored[i][0], scored[i][1]))
    ranks = {i: k + 1 for k, i in enumerate(able[: percent * len(able) // 100])}
    return sorted((r + (ranks.get(i),) for i, r in enumerate(scored)), key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    vocabulary = [a + b for a in ("Straße", "éa", "NO", "x1", "ÀB", "日本") for b in ("", "un", "IV", "9", "ß")]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "_", "-", "\x00"]) for _ in range(n))
    rows = [(i, text(rnd.randint(0, 60))) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 500)]
    return rows, [text(rnd.randint(1, 30)) for _ in range(12)]


def test_equals_the_plain_version(table, corpus):
    rows, targets = corpus
    found = resample.resample(table(rows), table([(0, t) for t in targets]), few=8)
    assert as_rows(found) == brute(rows, targets)
    how = {"buckets": 50, "percent": 37, "min_words": 5, "seed": 7}
    found = resample.resample(table(rows), table([(0, t) for t in targets]), few=1, **how)
    assert as_rows(found) == brute(rows, targets, **how)


def test_odd_rows(table, odd_rows, corpus):
    rows = odd_rows + corpus[0][:30]
    docs = table([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, rank int, score int, row int")
    for targets in (corpus[1], [None, ""], []):
        found = resample.resample(docs, table([(0, t) for t in targets]), percent=60, min_words=1, few=2)
        assert as_rows(found) == brute(rows, targets, percent=60, min_words=1)


def test_rows_of_one_id_and_text_are_a_third(table, corpus):
    rows = corpus[0][:100] + [(3, " ".join(f"w{i}" for i in range(40)))] * 60
    targets = [rows[-1][1]]
    for percent in (0, 10, 30, 50, 100):
        found = resample.resample(table(rows), table([(0, t) for t in targets]), percent=percent, few=1)
        assert as_rows(found) == brute(rows, targets, percent=percent)


def test_no_rows(table):
    empty, some = table([]), table([(1, "one two")])
    assert as_rows(resample.resample(empty, some)) == []
    assert as_rows(resample.resample(some, empty)) == brute([(1, "one two")], [])


def test_long_texts_are_cut_between_words(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab é_9Z\n") for _ in range(rnd.randint(0, 300))) for _ in range(40)]
    texts += ["y" * 500, "", "end", "z" * 90 + " " + "q" * 65]
    expected = [[zlib.crc32(w.encode()) % 997 for w in brute_words(t)] for t in texts]
    for limit in (1, 7, 64, 1 << 20):
        data, offsets = resample.hashing.text_bytes(pa.array(texts))
        spans = list(resample.blocks(data, offsets, limit))
        assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and spans[-1][1] == len(data)
        monkeypatch.setattr(resample.blocks, "__defaults__", (limit,))
        found = [[] for _ in texts]
        for text, bucket in resample._buckets(pa.array(texts), 997):
            for i, b in zip(text.tolist(), bucket.tolist()):
                found[i].append(b)
        assert found == expected


def test_cutoff_is_exact_whatever_the_order(spark):
    rng = np.random.default_rng(5)
    score = rng.integers(-50, 50, 5000)
    score[:2000] = 7
    rows = [(int(s), int(i % 40), 20, i) for i, s in enumerate(score)]
    able = spark.createDataFrame(rows, "score long, id long, n_features long, row long").repartition(7)
    ordered = sorted(resample.Key(-s, i, n, r) for s, i, n, r in rows)
    for winners in (1, 2, 1234, 2500, 4999, 5000):
        assert resample.cutoff_key(able, winners, few=3) == ordered[winners - 1]


def test_each_pivot_discards_a_quarter(spark):
    rng = np.random.default_rng(6)
    rows = [(int(s), i, 20, i) for i, s in enumerate(np.sort(rng.integers(0, 1000, 4000)))]
    keys = spark.createDataFrame(rows, "loss long, id long, n_features long, row long").repartition(9, "loss")
    pivot = resample._weighted_median(resample._medians(keys, None).collect())
    before = sum(resample.Key(*r) <= pivot for r in rows)
    assert 1000 <= before <= 3000
