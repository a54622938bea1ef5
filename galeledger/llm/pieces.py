"""Distinct pieces of text, each worked on once.

Tokenizers treat the pieces between safe boundaries independently, so every distinct
piece is encoded once and the others are looked up by their hash: in a table with one
entry a slot, and in a dictionary for entries whose slot is taken.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable

import numpy as np

from galeledger.llm import hashing

#: Known pieces; beyond them the half that was not used for longest is dropped.
KNOWN_PIECES = 1 << 19
#: Slots for each known piece at most.
_SPARE = 4


def worker_state(key: Hashable, make: Callable):
    """What ``make`` gives, kept as long as the Python worker lives, so that the tasks a
    worker runs one after the other share it. It must not change any result."""
    store = sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class Pieces:
    """Maps pieces to integer sequences through ``encode``, which returns the integers
    of all given pieces one after the other and how many each has."""

    def __init__(
        self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], lower: bool = False
    ):
        self.encode, self.lower = encode, lower
        self.names = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.uint32)
        self.used = np.zeros(0, np.int64)
        self.calls = 0
        self._index()

    def _index(self) -> None:
        """Enter all known pieces into a table with room for more."""
        bits = max(12, int(_SPARE * len(self.names)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.others: dict[int, int] = {}
        self._enter(0)

    def _enter(self, begin: int) -> None:
        entry = np.arange(begin, len(self.names))
        slot = (self.names[begin:] >> self.shift).astype(np.int64)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = entry[free]
        other = entry[self.slots[slot] != entry]
        self.others.update(zip(self.names[other].tolist(), other.tolist()))

    def _drop_half(self) -> None:
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 :])
        self.values, _ = self.sequences(keep)
        self.names, self.size, self.used = self.names[keep], self.size[keep], self.used[keep]
        self.first = np.cumsum(self.size) - self.size
        self._index()

    def look_up(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Index of each piece among the known ones; new ones are encoded first. It holds
        until the next call."""
        if len(self.names) > KNOWN_PIECES:
            self._drop_half()
        names = hashing.hash_words(hashing.lowered(data) if self.lower else data, starts, stops)
        out = self._find(names)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            distinct, at, back = np.unique(names[missing], return_index=True, return_inverse=True)
            found = np.fromiter((self.others.get(x, -1) for x in distinct.tolist()), np.int64, len(distinct))
            new = np.flatnonzero(found < 0)
            if len(new):
                found[new] = len(self.names) + np.arange(len(new))
                self._learn(data, starts[missing[at[new]]], stops[missing[at[new]]], distinct[new])
            out[missing] = found[back]
        self.calls += 1
        self.used[out] = self.calls
        return out

    def _find(self, names: np.ndarray) -> np.ndarray:
        out = self.slots[(names >> self.shift).astype(np.int64)].astype(np.int64)
        if not len(self.names):
            return out
        return np.where((out >= 0) & (self.names[out] == names), out, -1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, names: np.ndarray) -> None:
        raw = data.tobytes()
        flat, size = self.encode([raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
        begin = len(self.names)
        self.first = np.concatenate([self.first, len(self.values) + np.cumsum(size) - size])
        self.values = np.concatenate([self.values, flat])
        self.names = np.concatenate([self.names, names])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.zeros(len(size), np.int64)])
        if len(self.names) * _SPARE > 2 * len(self.slots):
            self._index()
        else:
            self._enter(begin)

    def sequences(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of known pieces one after the other, and their numbers."""
        size = self.size[known]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(
            self.first[known] - (ends - size), size
        )
        return self.values[at], size


def resolve(model: str) -> str:
    """A tokenizer file by its path, or by its name among the installed public ones."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each slice between consecutive bounds; empty slices give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
