"""Near-duplicate classes by DartMinHash over weighted word shingles.

Each element (a five-word shingle, weighted by its count) owns a strip of the plane
of weight and rank, on which hashed darts fall as a Poisson process. A text is hit
by the darts below its element's weight, of any rank up to a bound that gives about
``k ln k + 2k`` hits in all; each dart belongs to one of ``k`` coordinates, and
the dart of lowest rank per coordinate is the signature. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. A text costs
its number of shingles plus its hits, whatever ``k`` is. Texts that leave a
coordinate without a dart are thrown at again with twice the bound.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from galeledger.llm import hashing, near

BANDS, BAND_ROWS = 20, 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ELEMENT = np.uint64((1 << 48) - 1)


def near_duplicates(
    docs: DataFrame, threshold: float = near.SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, class_id)`` per row of ``docs``; see :func:`near.near_classes` for
    null, empty and short texts. A similarity of 0.8 shares one of the 20 bands of 5
    coordinates with a probability of 0.9996."""
    return near.near_classes(docs, dart_bands, threshold, id_col=id_col, text_col=text_col)


def deduplicate(docs: DataFrame, threshold: float = near.SIMILARITY) -> DataFrame:
    """One row of each class, the one with the smallest id; see :func:`near.keep_one`."""
    return near.keep_one(docs, dart_bands, threshold)


def dart_bands(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Band hashes (texts x bands) of texts given by their shingles."""
    return band_hashes(dart_signatures(x, begins, BANDS * BAND_ROWS), BANDS)


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    total = np.zeros((len(signatures), bands), np.uint64)
    for k in range(rows):
        total = hashing.mix(total + signatures[:, k : bands * rows : rows], 50 + k)
    return hashing.mix(total + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def weighted(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, element (48 bits) and count of each distinct shingle of each text; at most
    65536 texts."""
    text = np.repeat(np.arange(len(begins) - 1, dtype=np.uint64), np.diff(begins))
    key = np.sort((text << np.uint64(48)) | (x >> np.uint64(16)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(48)).astype(np.int64), key & _ELEMENT, count


def dart_signatures(x: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """Signatures (texts x k, 32-bit dart names); texts without shingles have zeros."""
    n = len(begins) - 1
    out = np.zeros((n, k), np.uint64)
    for low in range(0, n, 1 << 16):
        high = min(n, low + (1 << 16))
        part = begins[low : high + 1]
        out[low:high] = _signatures(x[part[0] : part[-1]], part - part[0], k)
    return out


def _signatures(x: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    n = len(begins) - 1
    text, element, count = weighted(x, begins)
    weight = np.diff(begins).astype(float)
    bound = np.divide(k * math.log(k) + 2 * k, weight, out=np.zeros(n), where=weight > 0)
    best = np.full(n * k, _NONE)
    todo = weight > 0
    while todo.any():
        own = todo[text]
        _throw(text[own], element[own], count[own], bound, k, best)
        todo = todo & (best.reshape(n, k) == _NONE).any(axis=1)
        bound[todo] *= 2
    out = best.reshape(n, k) & np.uint64(0xFFFFFFFF)
    out[weight == 0] = 0
    return out


def _throw(text, element, count, bound, k, best) -> None:
    """Take every dart of rank up to the bound that hits into ``best``."""
    level, low, width = 0, 0.0, 1.0
    while len(text):
        _throw_level(text, element, count, bound[text], level, low, width, k, best)
        level, low = level + 1, low + width
        width = low
        more = count > low
        text, element, count = text[more], element[more], count[more]


def _throw_level(text, element, count, bound, level, low, width, k, best) -> None:
    """Darts in the region of weights from ``low`` to ``low + width``: their ranks are
    the arrivals of a Poisson process of rate ``width``."""
    rank = np.zeros(len(text))
    arrival = 0
    # The first arrival of most elements comes too late; that needs no logarithm.
    late = np.exp(-bound * width)
    while len(text):
        name = hashing.mix(element, level * 100_003 + arrival)
        u = ((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        if arrival == 0:
            hit = u >= late
            text, element, count, bound = text[hit], element[hit], count[hit], bound[hit]
            name, u, rank = name[hit], u[hit], rank[hit]
        rank = rank - np.log(u) / width
        hit = rank <= bound
        text, element, count, bound = text[hit], element[hit], count[hit], bound[hit]
        name, rank = name[hit], rank[hit]
        dart = hashing.mix(name, 11)
        at = low + width * ((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        inside = at < count
        chosen = hashing.mix(dart, 12)[inside]
        value = rank[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        value |= chosen & np.uint64(0xFFFFFFFF)
        coordinate = ((chosen >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, text[inside] * k + coordinate, value)
        arrival += 1
