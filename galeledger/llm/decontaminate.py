"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct five-word shingles, a class up to
twice the size of the last. The MinHash sketch of an item is its least shingles in a
hashed order, as many as its class asks for: a document that holds a share ``t`` of an
item of at most ``u`` shingles lacks at most ``(1 - t) u`` of them, so of a sketch of
that many and ``h`` more it holds ``h`` at least, wherever in the document they stand.
Nothing is missed by chance, and repeats within an item don't count. Shingles of many
items come last in the order, so that common phrases don't make candidates. An item of
fewer than five words is one shingle, and is looked for in the windows of its length.

Documents never meet all items: their shingles are tested against bitmaps of the
sketches and of all items' shingles, whose size is measured and bounded, and those that
pass are joined to the sketches by key. Every candidate is verified by the exact
containment of the item's shingles in the whole document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeledger.llm import hashing
from galeledger.llm.tables import ascending, documents, materialise, packed

CONTAINMENT = 0.8
SHINGLE_WORDS = 5
#: Shingles of an item's sketch that a document must hold, if the item has as many.
SKETCH_HITS = 4
#: Items beyond which a shingle comes last in the order.
COMMON = 16
#: Bits for each key of a bitmap, and the most (32 MB) of one.
KEY_BITS = 32
BITMAP_BITS = 1 << 28


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = CONTAINMENT,
    words: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for every document that
    holds an item: at least ``threshold`` of the item's distinct shingles, anywhere in
    the document.

    Items without words are in no document; an item of fewer than ``words`` words is in
    the documents in which its words follow each other. Null and empty texts hold
    nothing. Repeated rows give one row. A null document id counts as the greatest, null
    item ids are one item. Without documents or items the result is empty. Other columns
    are ignored.
    """
    held = _holders(docs, items, threshold, words, id_col, text_col, item_col, item_text_col)
    return (
        held.groupBy("doc_id", "item_id", "n_shingles")
        .agg(F.max("n_shared").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    )


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = CONTAINMENT,
    words: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see
    :func:`contaminated`. Rows are judged by their text: of rows with one id (or none)
    those that hold no item stay, repeated rows all or none."""
    held = _holders(docs, items, threshold, words, id_col, text_col, item_col, item_text_col)
    bad = held.select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(packed(docs), ascending(F.col(id_col)).alias("own_id"), F.md5(text).alias("own_digest"))
    same = (keyed["own_id"] == bad["bad_id"]) & (keyed["own_digest"] == bad["bad_digest"])
    return keyed.join(bad, same, "left_anti").select("row.*")


def _holders(docs, items, threshold, words, id_col, text_col, item_col, item_text_col) -> DataFrame:
    """``(doc_id, digest, item_id, n_shingles, n_shared)`` of the rows that hold an item;
    the digest is that of the row's text."""
    plain = documents(docs, id_col=id_col, text_col=text_col)
    known = items.select(
        F.col(item_col).cast("long").alias("item_id"),
        F.coalesce(F.col(item_text_col), F.lit("")).alias("text"),
    )
    index = materialise(
        known.mapInArrow(
            lambda it: _index(it, words), "item_id long, n_words int, n_shingles long, shingles array<long>"
        ).withColumn("set_id", F.xxhash64("shingles")),
        "items",
    )
    sets = index.dropDuplicates(["set_id"]).select("set_id", "n_shingles", "shingles")
    sketch = materialise(_sketches(sets, threshold), "sketches")
    # Fewer than ``words`` different numbers.
    short = sorted(r["n_words"] for r in index.filter(F.col("n_words") < words).select("n_words").distinct().collect())
    every = _bitmap(sets.select(F.explode("shingles").alias("key")))
    bits = docs.sparkSession.sparkContext.broadcast((_bitmap(sketch), every))
    found = materialise(
        plain.mapInArrow(
            lambda it: _probe(it, words, short, *bits.value),
            "doc_id long, digest string, keys array<long>, shingles array<long>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "found",
    )
    pairs = (
        found.select("row", F.explode("keys").alias("key"))
        .join(sketch, "key")
        .groupBy("row", "set_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.min("need").alias("need"))
        .filter("hits >= need")
        .select("row", "set_id")
    )
    shared = F.size(F.array_intersect("shingles", "of_item")).cast("long")
    return (
        pairs.join(sets.withColumnRenamed("shingles", "of_item"), "set_id")
        .join(found.select("row", "doc_id", "digest", "shingles"), "row")
        .select("doc_id", "digest", "set_id", "n_shingles", shared.alias("n_shared"))
        .filter(F.col("n_shared") >= F.col("n_shingles") * F.lit(threshold))
        .join(index.select("item_id", "set_id").distinct(), "set_id")
    )


def _sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """``(key, set_id, need)``: the bottom-k sketch of every item, with the k of its size
    class, and how many of its shingles a document that holds the item has at least."""
    size_class = F.floor(F.log2("n_shingles"))
    smallest = F.pow(F.lit(2.0), size_class)
    largest = smallest * 2 - 1
    sure = lambda n: F.greatest(F.ceil(n * F.lit(threshold)), F.lit(1))
    need = F.least(sure(smallest), F.lit(SKETCH_HITS))
    grams = sets.select(
        "set_id",
        need.alias("need"),
        (largest - sure(largest) + need).alias("k"),
        F.explode("shingles").alias("key"),
    )
    uses = grams.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy("set_id").orderBy(F.col("uses") > COMMON, F.xxhash64("key"), "key")
    return (
        grams.join(uses, "key")
        .withColumn("place", F.row_number().over(order))
        .filter("place <= k")
        .select("key", "set_id", "need")
    )


def _lists(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))


def _index(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part in hashing.slices(batches):
        x, begins, first = _shingles(part.column("text"), words, [])
        grams = [np.unique(x[a:b]) for a, b in zip(begins[:-1], begins[1:])]
        rows = [row for row, own in enumerate(grams) if len(own)]
        grams = [grams[row] for row in rows]
        yield pa.record_batch(
            [
                part.column("item_id").take(pa.array(rows, pa.int64())),
                pa.array([min(b - a, words) for row in rows for a, b in [first[row : row + 2]]], pa.int32()),
                pa.array([len(own) for own in grams], pa.int64()),
                _lists(grams),
            ],
            ["item_id", "n_words", "n_shingles", "shingles"],
        )


def _shingles(texts: pa.Array, words: int, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts and the index of each text's first one, with the windows of
    some smaller numbers of words after them; and the index of each text's first word."""
    data, offsets = hashing.text_bytes(texts)
    starts, stops, first = hashing.word_spans(data, offsets)
    hashes = hashing.hash_spans(data, starts, stops)
    x, begins = hashing.windows(hashes, first, words, whole=True)
    if not short:
        return x, begins, first
    # A text of as many words is the same shingle as a window of them.
    parts = [(x, begins)] + [hashing.short_windows(hashes, first, n) for n in short]
    owner = np.concatenate([np.repeat(np.arange(len(b) - 1), np.diff(b)) for _, b in parts])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(texts))
    return np.concatenate([p for p, _ in parts])[order], np.concatenate([[0], np.cumsum(counts)]), first


def _bitmap(keys: DataFrame) -> bytes:
    """Bits of the keys modulo the bitmap's length, which their number sets."""
    number = max(1, keys.count())
    size = min(BITMAP_BITS, 1 << max(15, (KEY_BITS * number - 1).bit_length()))
    # Spark counts the bits of these functions from 1.
    bit = F.col("key").bitwiseAND(size - 1) + 1
    rows = (
        keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        .collect()
    )
    out = bytearray(size // 8)
    for row in rows:
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = row["bits"]
    return bytes(out)


def _known(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = (keys & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _probe(
    batches: Iterator[pa.RecordBatch], words: int, short: list[int], sketched: bytes, every: bytes
) -> Iterator[pa.RecordBatch]:
    """Documents with a shingle that a sketch may have: these shingles, and all that an
    item may have."""
    sketch_bits, item_bits = np.frombuffer(sketched, np.uint8), np.frombuffer(every, np.uint8)
    for part in hashing.slices(batches):
        x, begins, _ = _shingles(part.column("text"), words, short)
        at = np.flatnonzero(_known(item_bits, x))
        x = x[at]
        hit = _known(sketch_bits, x)
        rows = np.unique(np.searchsorted(begins, at[hit], side="right") - 1)
        bounds = np.searchsorted(at, begins)
        keys, grams = [], []
        for a, b in zip(bounds[rows], bounds[rows + 1]):
            keys.append(np.unique(x[a:b][hit[a:b]]))
            grams.append(np.unique(x[a:b]))
        taken = part.take(pa.array(rows, pa.int64()))
        digests = [hashlib.md5((t.as_py() or "").encode()).hexdigest() for t in taken.column("text")]
        yield pa.record_batch(
            [taken.column("doc_id"), pa.array(digests, pa.string()), _lists(keys), _lists(grams)],
            ["doc_id", "digest", "keys", "shingles"],
        )
