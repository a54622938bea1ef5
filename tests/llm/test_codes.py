"""Vector codes against a plain version that compares every part with every entry."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from galeledger.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """``{row number: (code, error)}`` and the digest of the codebooks."""
    whole = {
        i: [math.floor(scale * float(np.float32(x))) for x in r[1]]
        for i, r in enumerate(rows)
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    }
    sizes = [len(v) for v in whole.values() if v and len(v) % parts == 0]
    d = min(set(sizes), key=lambda n: (-sizes.count(n), n)) if sizes else 0
    coded = {i: v for i, v in whole.items() if len(v) == d and d}
    last = (1 << 63) - 1
    order = sorted(coded, key=lambda i: (last if rows[i][0] is None else rows[i][0], rows[i][0] is None, coded[i]))
    cut = lambda v, p: v[p * d // parts : (p + 1) * d // parts]
    books = [[cut(coded[i], p) for i in order[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for v in coded.values():
                members.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [
                [math.floor(sum(x) / len(members[k])) for x in zip(*members[k])] if k in members else e
                for k, e in enumerate(book)
            ]
    out = {i: (None, None) for i in whole}
    for i, v in coded.items():
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(x for x, _ in found)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def expected(rows, **how):
    coded, digest = brute(rows, **how)
    errors = {}
    for i, (_, error) in coded.items():
        errors.setdefault(rows[i][2], []).append(error)
    total = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in errors.items()}
    return sorted(((rows[i][0], c, e, total[rows[i][2]], digest) for i, (c, e) in coded.items()), key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_codes_equal_comparing_everything(table):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(16)], i % 5, "x", 1) for i in range(700)]
    # A hot vector, ties, equal ids and missing labels.
    rows += [(1000 + i, rows[7][1], None, None, None) for i in range(300)]
    rows += [(3, [round(rnd.gauss(0, 0.2), 2) for _ in range(16)], 9, None, None) for _ in range(20)]
    assert as_rows(vector_codes.compress(table(rows, SCHEMA))) == expected(rows)


def test_small_codebooks_and_other_parameters(table):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.5]) for _ in range(6)], 0, None, None) for i in range(60)]
    how = {"parts": 3, "entries": 5, "rounds": 2, "scale": 10}
    assert as_rows(vector_codes.compress(table(rows, SCHEMA), **how)) == expected(rows, **how)


def test_odd_vectors(table):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2, 0.3, 0.4], 1, None, None),
        (1, [0.1, 0.2, 0.3, 0.4], 1, None, None),
        (None, [0.5, -0.2, 0.3, -0.0], None, None, None),
        (2, None, 1, None, None),
        (3, [0.1, None, 0.3, 0.4], 1, None, None),
        (4, [0.1, nan, 0.3, 0.4], 1, None, None),
        (5, [0.1, inf, 0.3, 0.4], 1, None, None),
        (6, [0.1] * 8, 7, None, None),
        (7, [0.1] * 3, 1, None, None),
        (8, [], 1, None, None),
    ]
    assert as_rows(vector_codes.compress(table(rows, SCHEMA))) == expected(rows)
    huge = [(9, [1e38] * 4, 1, None, None)]
    found = as_rows(vector_codes.compress(table(rows + huge, SCHEMA)))
    assert found == sorted(expected(rows) + [(9, None, None) + expected(rows)[0][3:]], key=str)


def test_no_vectors(table):
    assert as_rows(vector_codes.compress(table([], SCHEMA))) == []
    assert as_rows(vector_codes.compress(table([(1, None, 1, None, None)], SCHEMA))) == []
    found = as_rows(vector_codes.compress(table([(1, [0.5], 1, None, None)], SCHEMA)))
    assert found == [(1, None, None, None, hashlib.sha256(b"").hexdigest())]


def test_any_width_and_a_forgotten_memory_give_the_nearest(monkeypatch):
    rng = np.random.default_rng(1)
    book = rng.integers(-200, 200, (40, 6))
    points = np.concatenate([rng.integers(-250, 250, (900, 6)), np.repeat(book[:3], 50, axis=0)])
    every = ((points[:, None, :] - book) ** 2).sum(axis=2)
    monkeypatch.setattr(vector_codes, "CELLS", 50)
    monkeypatch.setattr(vector_codes, "BLOCK", 40 * 6 * 16)
    for width in (None, 1, 2, 64, 4096):
        finder = vector_codes.Cells(book, width)
        for _ in range(2):
            index, distance = finder.nearest(points)
            assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_equal_hashes_of_different_cells(monkeypatch):
    rng = np.random.default_rng(2)
    book = rng.integers(-50, 50, (9, 4))
    points = rng.integers(-60, 60, (200, 4))
    every = ((points[:, None, :] - book) ** 2).sum(axis=2)
    finder = vector_codes.Cells(book)
    monkeypatch.setattr(vector_codes.hashing, "mix", lambda x, seed=0: x % np.uint64(3))
    for _ in range(2):
        assert (finder.nearest(points)[0] == every.argmin(axis=1)).all()


def test_lists_are_short(table):
    rng = np.random.default_rng(3)
    book = rng.normal(0, 128, (256, 16)).astype(int)
    points = rng.normal(0, 128, (2000, 16)).astype(int)
    finder = vector_codes.Cells(book)
    finder.nearest(np.repeat(points, 3, axis=0))
    assert len(finder.keys) <= 2000 and finder.counts.mean() < 30
