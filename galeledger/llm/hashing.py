"""Vectorised hashing of words and word windows, as numpy helpers for Arrow tasks.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``;
texts are UTF-8, and null counts as empty. Everything works on slices of a
record batch of a few megabytes of text, so memory does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_BLOCK = 1 << 20
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Random value of a byte at a position of a word, positions modulo 32.
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(
    0, 1 << 63, size=32 * 256, dtype=np.uint64
) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + np.uint64((0xD1B54A32D192ED03 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after the other, and the offsets."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if data is None or first == last:
        return np.zeros(0, np.uint8), offsets - first
    return np.frombuffer(data, np.uint8)[first:last], offsets - first


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def word_spans(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word, and per text the index of its first
    word (one more entry at the end). Words end at the end of their text."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    change = np.diff(inside)
    begins = change == 1
    ends = change == -1
    # A text that starts inside a run of bytes cuts it in two.
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    cut = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
    begins[cut] = True
    ends[cut] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def hash_spans(
    data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = False
) -> np.ndarray:
    """64-bit hash of each byte span (spans ascend and don't overlap)."""
    out = np.empty(len(starts), np.uint64)
    lengths = stops - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    begin = 0
    while begin < len(starts):
        end = int(np.searchsorted(total, total[begin] + _BLOCK, side="right")) - 1
        end = min(max(end, begin + 1), len(starts))
        size = lengths[begin:end]
        first = total[begin:end] - total[begin]
        n = int(total[end] - total[begin])
        sums = np.zeros(end - begin, np.uint64)
        if n:
            low = starts[begin]
            inside = np.zeros(stops[end - 1] - low + 1, np.int8)
            full = size > 0
            inside[starts[begin:end][full] - low] += 1
            inside[stops[begin:end][full] - low] -= 1
            piece = data[low : stops[end - 1]][np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
            if lower:
                piece = _LOWER[piece]
            place = np.ones(n, np.int32)
            place[0] = 0
            heads = first[full]
            place[heads[1:]] = 1 - size[full][:-1]
            np.cumsum(place, out=place)
            value = _TABLE[((place & 31) << 8) + piece]
            if int(size.max()) > 32:
                value *= np.uint64(2) * (place >> 5).astype(np.uint64) * _ROOT + np.uint64(1)
            sums[full] = np.add.reduceat(value, heads)
        out[begin:end] = mix(sums + size.astype(np.uint64) * _ROOT)
        begin = end
    return out


#: Longer spans are hashed byte by byte.
_WORD_BYTES = 64


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII letters in lower case."""
    return _LOWER[data]


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time (spans ascend and don't
    overlap). Other hashes than :func:`hash_spans`."""
    size = stops - starts
    room = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    room[: len(data)] = data
    eights = room.view("<u8")
    mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def load(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place on."""
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        # Two shifts, as one by 64 isn't defined.
        high = (eights[place + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return ((eights[place] >> shift) | high) & mask[np.minimum(left, 8)]

    out = mix(load(starts, size) + size.astype(np.uint64) * _ROOT)
    more = np.flatnonzero(size > 8)
    done = 8
    while len(more) and done < _WORD_BYTES:
        out[more] = mix(out[more] + load(starts[more] + done, size[more] - done) * _INVERSE, 1)
        done += 8
        more = more[size[more] > done]
    if len(more):
        out[more] ^= hash_spans(data, starts[more], stops[more])
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries, at its first position; the array is
    ``len(words) - n + 1`` long, or empty."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if n <= 8:
        total = words[:count].copy()
        for k in range(1, n):
            total *= _ROOT
            total += words[k : k + count]
        return mix(total, n)
    power = np.full(len(words) + 1, _ROOT, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[:-1], out=sums[1:])
    back = np.full(count, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((sums[n:] - sums[:count]) * back, n)


def windows(
    words: np.ndarray, first: np.ndarray, n: int, whole: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows inside each text, text after text, and the index of each
    text's first window. ``first`` holds the index of each text's first word. With
    ``whole``, a text of 1 to n-1 words has one window, of all its words."""
    counts = np.diff(first)
    every = window_hashes(words, n)
    sizes = np.maximum(counts - n + 1, 0)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(int(begins[-1])) + np.repeat(first[:-1] - begins[:-1], sizes)
    out = every[at] if len(at) else np.zeros(0, np.uint64)
    if not whole:
        return out, begins
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return out, begins
    extra = np.empty(len(short), np.uint64)
    for k in range(1, n):
        rows = np.flatnonzero(counts[short] == k)
        if len(rows):
            total = words[first[short[rows]]].copy()
            for j in range(1, k):
                total *= _ROOT
                total += words[first[short[rows]] + j]
            extra[rows] = mix(total, 1000 + k)
    out = np.insert(out, begins[short], extra)
    sizes[short] = 1
    return out, np.concatenate([[0], np.cumsum(sizes)])


def short_windows(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`windows`, with the hashes that ``whole`` gives texts of ``n`` words."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(int(begins[-1])) + np.repeat(first[:-1] - begins[:-1], counts)
    total = words[at].copy()
    for k in range(1, n):
        total *= _ROOT
        total += words[at + k]
    return mix(total, 1000 + n), begins


def shingles(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles (case kept) of each text and the index of each
    text's first one; shorter texts have one shingle of all their words, texts
    without words none."""
    data, offsets = text_bytes(texts)
    starts, stops, first = word_spans(data, offsets)
    return windows(hash_spans(data, starts, stops), first, n, whole=True)


def binary_array(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column of consecutive slices of a numpy array."""
    raw = np.ascontiguousarray(parts)
    where = (np.asarray(bounds, np.int64) * raw.itemsize).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(where) - 1, [None, pa.py_buffer(where), pa.py_buffer(raw)]
    ).cast(pa.binary())
