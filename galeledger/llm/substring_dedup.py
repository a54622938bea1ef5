"""Exact substring deduplication with fixed-block anchors.

A passage is removed from a document if it covers a window of ``window`` words
whose word sequence also starts in a document with a smaller id.

Method: every document is cut into non-overlapping reference blocks of
``(window + 1) // 2`` words, so each window holds a whole block. The blocks are
the index; the rolling windows of block length of every document probe it. Hits
are extended to whole windows, and the extended windows of all documents are
compared at once: the smallest id per window decides. Overlapping windows join
into maximal exact repeats.

How it scales: documents are gathered into chunks of a few megabytes by a hash of
their id, and a chunk sends one packed array per bucket of the hash
space, with each hash once per chunk. A passage in a third of all documents
therefore costs one entry per chunk, not per document, and never a pair. Answers
go back to the chunk, which computes its hashes again. The number of chunks and
buckets follows the bytes of text, so a task's share stays the same. Anchors are
32 bits within a bucket; a false hit only adds windows to the exact comparison,
which uses 64 bits within a bucket of an independent hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeledger.llm import hashing
from galeledger.llm.tables import chunk_count, documents, row_bytes

#: Bytes of text in a chunk: least and most. Between them they follow the square root
#: of the input, so that a chunk's array for a bucket keeps dozens of entries.
CHUNK_BYTES = 4 << 20, 64 << 20
#: A bucket gets the windows of so many times the bytes of a chunk.
BUCKET_CHUNKS = 4

_ANCHORS = "chunk long, bucket int, hashes binary, flags binary"
_HITS = "chunk long, bucket int, hit binary"
_WINDOWS = "chunk long, bucket int, hashes binary, owners binary"
_OWNERS = "chunk long, bucket int, at binary, owners binary"
_RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, stop: long>>, kept_text string"

#: Flags of an anchor hash in a chunk.
_BLOCK, _SEVERAL = 1, 2


def remove_repeats(
    docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept_text)`` per row of ``docs``.

    ``removed`` lists word positions ``[start, stop)``; ``kept_text`` has the other
    words joined by one space. Null and empty texts have no words. Rows with the
    same id are one author: they don't remove each other's passages. A null id
    counts as the greatest. Other columns are ignored; an empty table gives none.
    """
    block = (window + 1) // 2
    plain = documents(docs, id_col=id_col, text_col=text_col)
    _, total = row_bytes(plain)
    least, most = CHUNK_BYTES
    chunk_bytes = min(most, max(least, int(6.4 * total**0.5)))
    chunks = chunk_count(total, chunk_bytes)
    buckets = chunk_count(total, BUCKET_CHUNKS * chunk_bytes)
    chunked = plain.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))

    anchors = chunked.groupBy("chunk").applyInArrow(
        lambda t: _emit_anchors(t, window, block, buckets), _ANCHORS
    )
    hits = anchors.groupBy("bucket").applyInArrow(_shared_anchors, _HITS)
    windows = (
        chunked.groupBy("chunk")
        .cogroup(hits.groupBy("chunk"))
        .applyInArrow(lambda t, h: _emit_windows(t, h, window, block, buckets), _WINDOWS)
    )
    owners = windows.groupBy("bucket").applyInArrow(_first_owners, _OWNERS)
    # The windows a chunk sent are found again from the same hits.
    asked = hits.select("chunk", "bucket", "hit", F.lit(None).cast("binary").alias("owners"))
    told = owners.select("chunk", "bucket", F.col("at").alias("hit"), "owners")
    return (
        chunked.groupBy("chunk")
        .cogroup(asked.unionByName(told).groupBy("chunk"))
        .applyInArrow(lambda t, h: _cut(t, h, window, block, buckets), _RESULT)
    )


class _Chunk:
    """Words of the documents of a chunk, in a fixed order, and their anchors."""

    def __init__(self, table: pa.Table, window: int, block: int, buckets: int):
        keys = [("doc_id", "ascending"), ("text", "ascending")]
        table = table.select(["chunk", "doc_id", "text"]).sort_by(keys).combine_chunks()
        self.chunk = table["chunk"][0].as_py() if table.num_rows else None
        self.ids = np.asarray(table["doc_id"].combine_chunks(), np.int64)
        text = table["text"].combine_chunks()
        self.data, offsets = hashing.text_bytes(text)
        self.starts, self.stops, self.first = hashing.word_spans(self.data, offsets)
        self.words = hashing.hash_spans(self.data, self.starts, self.stops)
        self.counts = np.diff(self.first)
        self.document = np.repeat(np.arange(len(self.ids)), self.counts)
        self.place = np.arange(len(self.words)) - self.first[self.document]
        self.window, self.block, self.buckets = window, block, buckets
        rolling = hashing.window_hashes(self.words, block)
        valid = self._inside(block, len(rolling))
        rolling = rolling[valid]
        bucket = _bucket(rolling, buckets)
        # Distinct (bucket, 32 bits) in order; ``group`` of each rolling window.
        key = (bucket.astype(np.uint64) << np.uint64(32)) | (rolling & np.uint64(0xFFFFFFFF))
        self.anchor_at = valid
        self.anchor_keys, self.group = np.unique(key, return_inverse=True)

    def _inside(self, n: int, count: int) -> np.ndarray:
        """Positions where a window of ``n`` words stays in its document."""
        at = self.document[:count]
        return np.flatnonzero(self.place[:count] + n <= self.counts[at])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys and their flags: one is a reference block, and whether
        documents with different ids have it."""
        flags = np.zeros(len(self.anchor_keys), np.uint8)
        ids = self.ids[self.document[self.anchor_at]]
        aligned = self.place[self.anchor_at] % self.block == 0
        flags[self.group[aligned]] |= _BLOCK
        some = np.empty(len(flags), np.int64)
        some[self.group] = ids
        flags[self.group[ids != some[self.group]]] |= _SEVERAL
        return self.anchor_keys, flags

    def candidates(self, hits: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """Hits extended to whole windows: their positions, and the distinct window
        hashes (by bucket), the index of each one, and the smallest id of each."""
        bounds = np.searchsorted(
            self.anchor_keys >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64)
        )
        hit = np.zeros(len(self.anchor_keys), bool)
        for bucket, at in hits:
            hit[bounds[bucket] + at] = True
        every = hashing.window_hashes(self.words, self.window)
        valid = self._inside(self.window, len(every))
        # A window counts if one of the block-long windows in it is a hit.
        mark = np.zeros(len(self.words) + 1, np.int64)
        mark[1:][self.anchor_at[hit[self.group]]] = 1
        np.cumsum(mark, out=mark)
        width = self.window - self.block + 1
        valid = valid[mark[valid + width] > mark[valid]]
        hashes = every[valid]
        bucket = _bucket(hashes, self.buckets)
        order = np.lexsort((hashes, bucket))
        sorted_hash, sorted_bucket = hashes[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_bucket[1:] != sorted_bucket[:-1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        keys, key_bucket = sorted_hash[new], sorted_bucket[new]
        smallest = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(smallest, index, self.ids[self.document[valid]])
        return valid, index, keys, key_bucket, smallest


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashing.mix(hashes, 77) % np.uint64(buckets)).astype(np.int32)


def _by_bucket(chunk: int, buckets: np.ndarray, n: int, **arrays: np.ndarray) -> pa.Table:
    """One row per bucket that has entries, with its slices of the arrays."""
    bounds = np.searchsorted(buckets, np.arange(n + 1))
    full = np.flatnonzero(np.diff(bounds))
    cuts = np.append(bounds[full], bounds[-1])
    return pa.table(
        {
            "chunk": pa.array(np.full(len(full), chunk, np.int64)),
            "bucket": pa.array(full.astype(np.int32)),
        }
        | {k: hashing.binary_array(v, cuts) for k, v in arrays.items()}
    )


def _emit_anchors(table: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    own = _Chunk(table, window, block, buckets)
    keys, flags = own.anchors()
    return _by_bucket(
        own.chunk,
        (keys >> np.uint64(32)).astype(np.int64),
        buckets,
        hashes=(keys & np.uint64(0xFFFFFFFF)).astype(np.uint32),
        flags=flags,
    )


def _gather(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a packed column, row after row, and their number in each row."""
    packed = table[column].combine_chunks().cast(pa.large_binary())
    _, where, data = packed.buffers()
    offsets = np.frombuffer(where, np.int64)[packed.offset : packed.offset + len(packed) + 1]
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data or b"", np.uint8)[int(offsets[0]) : int(offsets[-1])]
    return raw.view(kind) if len(raw) % size == 0 else raw, np.diff(offsets) // size


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Per chunk, the positions in its packed array that are a reference block of
    one document and a rolling window of another."""
    hashes, sizes = _gather(table, "hashes", np.uint32)
    flags, _ = _gather(table, "flags", np.uint8)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(new)
    together = np.bitwise_or.reduceat(flags[order], begins) if len(begins) else flags
    count = np.diff(np.append(begins, len(order)))
    hit = ((together & _BLOCK) > 0) & ((count > 1) | ((together & _SEVERAL) > 0))
    marked = np.zeros(len(hashes), bool)
    marked[order] = np.repeat(hit, count)
    return _answer(table, sizes, marked, "hit")


def _answer(table: pa.Table, sizes: np.ndarray, marked: np.ndarray, name: str, **more) -> pa.Table:
    """Rows of the chunks with marked entries, and the positions of these."""
    ends = np.cumsum(sizes)
    at = np.flatnonzero(marked)
    row = np.searchsorted(ends, at, side="right")
    within = (at - (ends - sizes)[row]).astype(np.uint32)
    rows = np.unique(row)
    cuts = np.append(np.searchsorted(row, rows), len(row))
    columns = {
        "chunk": table["chunk"].combine_chunks().take(pa.array(rows)),
        "bucket": table["bucket"].combine_chunks().take(pa.array(rows)),
        name: hashing.binary_array(within, cuts),
    }
    return pa.table(columns | {k: hashing.binary_array(v[at], cuts) for k, v in more.items()})


def _hit_rows(table: pa.Table, column: str = "hit") -> list[tuple[int, np.ndarray]]:
    return [
        (bucket, np.frombuffer(at, np.uint32))
        for bucket, at in zip(table["bucket"].to_pylist(), table[column].to_pylist())
    ]


def _emit_windows(
    table: pa.Table, hits: pa.Table, window: int, block: int, buckets: int
) -> pa.Table:
    if not table.num_rows or not hits.num_rows:
        return pa.table(
            {"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()),
             "hashes": pa.array([], pa.binary()), "owners": pa.array([], pa.binary())}
        )
    own = _Chunk(table, window, block, buckets)
    _, _, keys, bucket, smallest = own.candidates(_hit_rows(hits))
    return _by_bucket(own.chunk, bucket, buckets, hashes=keys, owners=smallest)


def _first_owners(table: pa.Table) -> pa.Table:
    """Per chunk, the windows that a smaller id than its own has, with that id."""
    hashes, sizes = _gather(table, "hashes", np.uint64)
    owners, _ = _gather(table, "owners", np.int64)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(new)
    least = np.empty(len(hashes), np.int64)
    if len(begins):
        smallest = np.minimum.reduceat(owners[order], begins)
        least[order] = np.repeat(smallest, np.diff(np.append(begins, len(order))))
    return _answer(table, sizes, least < owners, "at", owners=least)


def _cut(table: pa.Table, answers: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """Documents without the words of windows that belong to a smaller id."""
    if not table.num_rows:
        return _rows(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), [], [])
    own = _Chunk(table, window, block, buckets)
    removed = np.zeros(len(own.words) + 1, np.int64)
    if answers.num_rows:
        told = answers["owners"].is_valid()
        valid, index, _, bucket, smallest = own.candidates(
            _hit_rows(answers.filter(pc.invert(told)))
        )
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        for row in answers.filter(told).select(["bucket", "hit", "owners"]).to_pylist():
            at = bounds[row["bucket"]] + np.frombuffer(row["hit"], np.uint32)
            smallest[at] = np.frombuffer(row["owners"], np.int64)
        gone = valid[smallest[index] < own.ids[own.document[valid]]]
        np.add.at(removed, gone, 1)
        np.add.at(removed, gone + window, -1)
    kept = np.cumsum(removed)[:-1] == 0
    n_removed = np.bincount(own.document[~kept], minlength=len(own.ids))
    spans = _spans(own, ~kept)
    return _rows(own.ids, own.counts, n_removed, spans, _joined(own, kept))


def _spans(own: _Chunk, gone: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in own.ids]
    if not gone.any():
        return out
    edge = np.ones(len(gone), bool)
    edge[1:] = (own.document[1:] != own.document[:-1]) | (gone[1:] != gone[:-1])
    begins = np.flatnonzero(edge)
    ends = np.append(begins[1:], len(gone))
    for a, b in zip(begins[gone[begins]], ends[gone[begins]]):
        out[own.document[a]].append(
            {"start": int(own.place[a]), "stop": int(own.place[b - 1]) + 1}
        )
    return out


def _joined(own: _Chunk, kept: np.ndarray) -> pa.Array:
    """Kept words of each document joined by one space."""
    lengths = (own.stops - own.starts)[kept] + 1
    document = own.document[kept]
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    out = np.full(total, 0x20, np.uint8)
    room = np.ones(total, bool)
    room[first + lengths - 1] = False
    inside = np.zeros(len(own.data) + 1, np.int8)
    np.add.at(inside, own.starts[kept], 1)
    np.add.at(inside, own.stops[kept], -1)
    out[room] = own.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    size = np.bincount(document, weights=lengths, minlength=len(own.ids)).astype(np.int64)
    # The space after a document's last word goes.
    ends = np.cumsum(size)
    if total:
        drop = np.ones(total, bool)
        drop[ends[size > 0] - 1] = False
        out = out[drop]
    bounds = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))]).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_string(), len(own.ids), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(out))]
    ).cast(pa.string())


def _rows(ids, counts, removed, spans, texts) -> pa.Table:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table(
        {
            "doc_id": pa.array(np.asarray(ids, np.int64)),
            "n_words": pa.array(np.asarray(counts, np.int64)),
            "n_removed": pa.array(np.asarray(removed, np.int64)),
            "removed": pa.array(spans, kind),
            "kept_text": texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()),
        }
    )
