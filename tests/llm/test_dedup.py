from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galeledger.llm import dart_minhash, hashing, minhash, near, substring_dedup
from tests.llm import brute

LAST = (1 << 63) - 1


def filled(rows):
    return [(LAST if i is None else i, t) for i, t in rows]


@pytest.mark.parametrize("window", [5, 8, 13])
def test_removed_passages_equal_brute_force(table, prose, window):
    found = substring_dedup.remove_repeats(table(prose), window)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect())
    assert got == brute.without_repeats(prose, window)
    assert any(r[2] for r in got)


def test_removed_spans_are_what_is_missing(table, prose):
    for row in substring_dedup.remove_repeats(table(prose), 8).collect():
        assert sum(s.stop - s.start for s in row.removed) == row.n_removed
        assert all(a.stop < b.start for a, b in zip(row.removed, row.removed[1:]))


def test_repeats_in_odd_rows(table, odd_rows):
    rows = filled(odd_rows)
    got = substring_dedup.remove_repeats(table(odd_rows), 5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    assert got == brute.without_repeats(rows, 5)


def test_repeats_of_many_chunks(table, monkeypatch, prose):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", (2000, 64 << 20))
    got = substring_dedup.remove_repeats(table(prose), 8)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    assert got == brute.without_repeats(prose, 8)


@pytest.mark.parametrize(
    "classes, counted",
    [(dart_minhash.near_duplicates, True), (minhash.near_duplicates, False)],
)
def test_near_classes_equal_brute_force(table, prose, odd_rows, classes, counted):
    rows = filled([(i + 100, t) for i, t in prose] + odd_rows)
    got = sorted(map(tuple, classes(table(rows)).collect()))
    assert got == brute.near_classes(rows, counted=counted)
    assert len({c for _, c in got}) < len({i for i, _ in got})


def test_near_classes_of_a_large_group_of_changed_copies(table):
    """Copies with 0 to 12 changed words: many fail with the hub, some are linked."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rnd.randint(0, 12)):
            text[rnd.randrange(80)] = f"x{rnd.randrange(10 ** 6)}"
        if i % 10 == 0:
            text = text[: rnd.randint(50, 79)]
        rows.append((i, " ".join(text)))
    for i in range(150, 165):  # copies of a changed copy
        rows.append((i, rows[7][1] + f" tail{i}"))
    x, begins = hashing.shingles(pa.array([t for _, t in rows]))
    bands = dart_minhash.dart_bands(x, begins)
    elements = near._elements(x, begins, True)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(np.intersect1d(elements[i], elements[j]))
            close = same / (len(elements[i]) + len(elements[j]) - same) >= 0.8
            if close and (bands[i] == bands[j]).any():
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least.setdefault(find(i), i)
    wanted = [(i, least[find(i)]) for i in range(len(rows))]
    assert sorted(map(tuple, dart_minhash.near_duplicates(table(rows)).collect())) == wanted


def two_families(n, seed=1):
    """Texts of one passage, half of them with one more, each with another word changed: of
    a family only neighbours are similar, and none are across."""
    rnd = random.Random(seed)
    base, more = [f"w{rnd.randrange(10 ** 6)}" for _ in range(80)], [f"p{rnd.randrange(10 ** 6)}" for _ in range(30)]
    out = []
    for i in range(n):
        text = base + more if i % 2 else list(base)
        text[rnd.randrange(80)] = f"c{i}"
        out.append((i, " ".join(text)))
    return out


def test_pairs_grow_with_the_texts_not_their_square(table, monkeypatch):
    made, compared = [], near._compared

    def counted(pairs, grams):
        made.append(pairs.count())
        return compared(pairs, grams)

    monkeypatch.setattr(near, "_compared", counted)
    sums = []
    for n in (1000, 4000):
        made.clear()
        classes = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(table(two_families(n))).collect()}
        assert set(classes.values()) == {0, 1} and all(c == i % 2 for i, c in classes.items())
        sums.append(sum(made))
    assert sums[1] < 5 * sums[0] and sums[1] < 8 * 4000


def test_classes_of_families_equal_brute_force(table):
    rnd = random.Random(9)
    rows = two_families(160) + [(200 + i, t) for i, (_, t) in enumerate(two_families(60, seed=2))]
    for i in range(40):  # chains: each a changed copy of the last
        text = rows[-1][1].split()
        for _ in range(rnd.randint(1, 2)):
            text[rnd.randrange(len(text))] = f"z{i}"
        rows.append((300 + i, " ".join(text)))
    assert sorted(map(tuple, dart_minhash.near_duplicates(table(rows)).collect())) == brute.near_classes(rows)


def test_fingerprints_equal_the_plain_ones():
    texts = ["a b c d e f g h", "one two", "", "p " * 40]
    x, begins = hashing.shingles(pa.array(texts))
    found = minhash.signatures(x, begins)
    for row in range(len(texts)):
        own = [int(v) for v in x[begins[row] : begins[row + 1]]]
        plain = [
            min((((v * int(a) + int(b)) % 2**64) >> 32 for v in own), default=0xFFFFFFFF)
            for a, b in zip(minhash._A, minhash._B)
        ]
        assert found[row].tolist() == plain
        assert minhash.fingerprint_strings(found[row : row + 1]) == ["".join(f"{v % 65536:04x}" for v in plain)]
    one, two = found[0].astype(int) % 65536, found[3].astype(int) % 65536
    assert minhash.likeness(found[:1], found[3:])[0] == sum(one == two) / 128


def test_one_of_each_class_stays(table, prose, odd_rows):
    odd = [r for r in odd_rows if r[1] != "another text of the same id"]
    rows = [(i + 100, t) for i, t in prose] + odd
    docs = table(rows).withColumn("__tid", F.lit("mine")).withColumn("bucket", F.col("doc_id"))
    kept = dart_minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted((LAST if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert got == sorted({c for _, c in brute.near_classes(filled(rows))})


def test_signatures_estimate_similarity():
    for share in (0.5, 0.8, 0.95):
        seen = []
        for turn in range(12):
            base = [f"{turn}a{i}" for i in range(300)]
            cut = round(300 * (1 - share) / (1 + share))
            other = base[: 300 - cut] + [f"{turn}b{i}" for i in range(cut)]
            x, begins = hashing.shingles(pa.array([" ".join(base), " ".join(other)]))
            darts = dart_minhash.dart_signatures(x, begins, 100)
            prints = minhash.signatures(x, begins)
            seen.append([(darts[0] == darts[1]).mean(), minhash.likeness(prints[:1], prints[1:])[0]])
        assert np.allclose(np.mean(seen, axis=0), share, atol=0.05)


def test_dart_signatures_weigh_counts():
    one = " ".join(["a b c d e"] * 60)  # few shingles with high counts
    two = " ".join(["a b c d e"] * 30)
    x, begins = hashing.shingles(pa.array([one, two]))
    agree = np.mean([(s[0] == s[1]).mean() for s in [dart_minhash.dart_signatures(x, begins, 400)]])
    weighted = sum((brute.shingles(one) & brute.shingles(two)).values())
    weighted /= sum((brute.shingles(one) | brute.shingles(two)).values())
    assert abs(agree - weighted) < 0.08


def test_signatures_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", "", "p q r", "a b c d e f g"]
    x, begins = hashing.shingles(pa.array(texts))
    together = dart_minhash.dart_signatures(x, begins, 50)
    prints = minhash.signatures(x, begins)
    for row, text in enumerate(texts):
        x, begins = hashing.shingles(pa.array([text]))
        assert (dart_minhash.dart_signatures(x, begins, 50)[0] == together[row]).all()
        assert (minhash.signatures(x, begins)[0] == prints[row]).all()


def test_edited_fingerprints(table, odd_rows):
    import hashlib

    rows = sorted(filled(odd_rows), key=lambda r: (r[0], r[1] or ""))
    got = sorted(minhash.against_edits(table(odd_rows)).collect(), key=lambda r: (r.doc_id, r.n_chars))
    wanted = []
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        wanted.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(wanted)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    single = dict(minhash.fingerprints(table(odd_rows[:1])).collect())
    assert single[1] in {r.fingerprint for r in got if r.doc_id == 1}


def test_edits_over_many_ranges(table, prose, monkeypatch):
    from galeledger.llm import order

    whole = {r.doc_id: r for r in minhash.against_edits(table(prose)).collect()}
    monkeypatch.setattr(order, "RANGE_BYTES", (1500, 3000))
    parts = {r.doc_id: r for r in minhash.against_edits(table(prose)).collect()}
    assert parts == whole


@pytest.mark.parametrize(
    "run",
    [
        substring_dedup.remove_repeats,
        dart_minhash.near_duplicates,
        dart_minhash.deduplicate,
        minhash.near_duplicates,
        minhash.against_edits,
        minhash.fingerprints,
    ],
)
def test_empty_table(table, run):
    """Columns named like the operators' own change nothing."""
    assert run(table([]).withColumn("chunk", F.lit(1)).withColumn("part", F.lit(1))).collect() == []
