from __future__ import annotations

import numpy as np
import pyarrow as pa

from galeledger.llm import hashing
from tests.llm import brute

TEXTS = ["a b c", "", "  x y\tz ", "abc", "def", None, "q" * 100 + " w " * 7 + " q", "é ü x y", "\n"]


def test_words_of_joined_texts():
    data, offsets = hashing.text_bytes(pa.array(TEXTS))
    starts, stops, first = hashing.word_spans(data, offsets)
    for row, text in enumerate(TEXTS):
        own = slice(first[row], first[row + 1])
        assert [bytes(data[a:b]).decode() for a, b in zip(starts[own], stops[own])] == brute.words(text)


def test_equal_words_have_equal_hashes_only():
    words = sorted({"".join(c) for c in __import__("itertools").product("abc", repeat=5)})
    data, offsets = hashing.text_bytes(pa.array([" ".join(words + words), "x" * 33, "x" * 65]))
    names = hashing.hash_spans(data, *hashing.word_spans(data, offsets)[:2])
    assert (names[: len(words)] == names[len(words) : 2 * len(words)]).all()
    assert len(set(names.tolist())) == len(words) + 2


def test_windows_stay_in_their_text():
    data, offsets = hashing.text_bytes(pa.array(["a b c d", "c d e", "a b", ""]))
    starts, stops, first = hashing.word_spans(data, offsets)
    names = hashing.hash_spans(data, starts, stops)
    found, begins = hashing.windows(names, first, 3, whole=True)
    assert begins.tolist() == [0, 2, 3, 4, 4]
    assert len(set(found.tolist())) == 4
    assert hashing.windows(names, first, 3)[1].tolist() == [0, 2, 3, 3, 3]


def test_long_windows_by_sums():
    words = np.random.default_rng(1).integers(0, 1 << 62, 200).astype(np.uint64)
    every = hashing.window_hashes(words, 25)
    for at in (0, 7, 175):
        assert hashing.window_hashes(words[at : at + 25], 25)[0] == every[at]


def test_slices_keep_rows():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 0, 30, 4, 4, 4)])], ["text"])
    parts = list(hashing.slices(iter([batch]), limit=10))
    assert [len(p) for p in parts] == [2, 1, 2, 1]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_words_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 90))) for _ in range(3000)] + [b"a" * n for n in range(1, 140)]
    seen = {}
    for lead in (b"", b"-", b"---"):
        data = np.frombuffer(lead + b" ".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1 + len(lead)
        starts = ends - [len(w) for w in words]
        for word, value in zip(words, hashing.hash_words(data, starts, ends).tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    none = np.zeros(0, np.int64)
    assert len(hashing.hash_words(np.zeros(0, np.uint8), none, none)) == 0
