"""MinHash fingerprints of texts, their likeness, and near-duplicate classes.

A fingerprint keeps, for each of 128 universal hash functions of the form
``(a x + b) mod 2^64`` (upper half), the smallest value over the five-word shingles
of the text, cut to 16 bits and written in hexadecimal. The share of equal
coordinates estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeledger.llm import hashing, near
from galeledger.llm.dart_minhash import band_hashes
from galeledger.llm.order import in_order

PERMUTATIONS = 128
BANDS = 25
_SPACE = np.random.Generator(np.random.PCG64(4)).integers(
    0, 1 << 63, size=(2, PERMUTATIONS), dtype=np.uint64
)
_A = _SPACE[0] * np.uint64(2) + np.uint64(1)
_B = _SPACE[1]
_PIECE = 1 << 15


def signatures(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Smallest value per text and hash function (texts x 128, 32 bits); texts without
    shingles have the largest value everywhere."""
    out = np.full((len(begins) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint64)
    full = np.flatnonzero(np.diff(begins))
    if not len(full):
        return out
    # Pieces that fit the processor's cache, cut anywhere; a text's pieces are joined.
    for low in range(0, len(x), _PIECE):
        piece = x[low : low + _PIECE]
        a = np.searchsorted(begins[full + 1], low, side="right")
        b = np.searchsorted(begins[full], low + len(piece), side="left")
        rows = full[a:b]
        at = np.maximum(begins[rows] - low, 0)
        for j in range(PERMUTATIONS):
            value = piece * _A[j]
            value += _B[j]
            value >>= np.uint64(32)
            out[rows, j] = np.minimum(out[rows, j], np.minimum.reduceat(value, at))
    return out


def fingerprint_strings(values: np.ndarray) -> list[str]:
    short = values.astype(np.uint16).astype(">u2")
    return [row.tobytes().hex() for row in short]


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of equal coordinates, row by row."""
    return (one.astype(np.uint16) == two.astype(np.uint16)).mean(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` per row; a null text counts as empty, and all texts
    without words have the same fingerprint."""
    plain = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.slices(batches):
            prints = fingerprint_strings(signatures(*hashing.shingles(part.column("text"))))
            yield pa.record_batch([part.column("doc_id"), pa.array(prints)], ["doc_id", "fingerprint"])

    return plain.mapInArrow(run, "doc_id long, fingerprint string")


def minhash_bands(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return band_hashes(signatures(x, begins), BANDS)


def near_duplicates(
    docs: DataFrame, threshold: float = near.SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, class_id)`` per row of ``docs``: bands of the signatures joined,
    Jaccard similarity of the shingle sets verified; see :func:`near.near_classes`."""
    return near.near_classes(
        docs, minhash_bands, threshold, counted=False, id_col=id_col, text_col=text_col
    )


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited copy of it, and how alike they are.

    The edit replaces the last ``n // 2`` code points by the first as many (or all) of
    the next text in ascending id (after the last: the first; ties by text). A null
    text is empty. Columns ``(doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)``. Texts move once, to the other texts
    of their range of ids.
    """
    return in_order(docs, _edit_part, _EDITED, id_col=id_col, text_col=text_col)


_EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _edit_part(table: pa.Table, rows: int) -> pa.Table:
    """``table``: the texts of a range in order, then the next one after the range."""
    texts = table["text"].combine_chunks()
    plain = texts.to_pylist()
    edited = []
    for row in range(rows):
        half = len(plain[row]) // 2
        edited.append(plain[row][: len(plain[row]) - half] + plain[row + 1][:half])
    prints = _in_slices(texts)
    changed = _in_slices(pa.array(edited, pa.string()))
    own, following = prints[:rows], prints[1 : rows + 1]
    return pa.table(
        {
            "doc_id": table["doc_id"].slice(0, rows),
            "n_chars": pa.array([len(t) for t in plain[:rows]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array(fingerprint_strings(own), pa.string()),
            "edited_fingerprint": pa.array(fingerprint_strings(changed), pa.string()),
            "near_edited": pa.array(likeness(own, changed)),
            "near_next": pa.array(likeness(own, following)),
        }
    )


def _in_slices(texts: pa.Array) -> np.ndarray:
    parts = [
        signatures(*hashing.shingles(part.column(0)))
        for part in hashing.slices(iter([pa.record_batch([texts], ["text"])]))
    ]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint64)
