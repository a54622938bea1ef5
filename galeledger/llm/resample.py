"""Importance resampling towards a target distribution of hashed words.

Words are hashed into buckets; a bucket's gain is the logarithm of its share in the
target texts over its share in all documents. Documents are scored array by array:
bytes, words, buckets and the sums of the gains are numpy arrays of a block of text.
Adding Gumbel noise drawn from a hash of the id makes taking the greatest scores a draw
without replacement in proportion to the weights.

The cutoff is found without sorting all rows. Every task names the median of its
remaining keys on either side of the last pivot; the median of these, weighted by how
many keys each stands for, is the next pivot. At least a quarter of what remains lies
on each side of it and one side is discarded, until few enough keys are left to be
sorted. Then only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeledger.llm import hashing
from galeledger.llm.tables import ascending, materialise

BUCKETS = 10_000
SEED = 2024
SHARE = 10
MIN_WORDS = 20
#: Remaining keys that are sorted at once.
FEW = 1 << 12
#: Keys that one median stands for, at most.
KEYS = 1 << 20
#: Winners in a sorted part, about.
PART_ROWS = 1 << 21
_LOWER = hashing._LOWER
#: Digits, letters and every byte of a character beyond ASCII belong to words.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    percent: int = SHARE,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    few: int = FEW,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` per row of ``docs``.

    Features are the words of the whole text, ASCII letters in lower case, with repeats.
    The weight is the floored mean of their buckets' gains, the score adds the noise of
    the id. Of the N rows with at least ``min_words`` words, ``floor(percent * N / 100)``
    are drawn: the greatest scores, then the smaller ids, then fewer features; they have
    ranks from 1. Rows that are equal in all of these (repeated rows) count apart; any
    of them may stand for another. Null and empty texts have no features and weight 0.
    A null id counts as the greatest 64-bit id, also for the noise, and is returned as
    null. Without target texts or features in them all shares of the target are equal.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    wanted = target.select(F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    scored = weights(rows, gain, buckets)
    key = ascending(F.col("doc_id"))
    scored = scored.select(
        "doc_id",
        "n_features",
        "weight",
        (F.col("weight") + noise(key, seed)).alias("score"),
        key.alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Once written, the number of a row is fixed.
    scored = materialise(scored, "scored")
    able = scored.filter(F.col("n_features") >= min_words)
    winners = able.count() * percent // 100
    cutoff = cutoff_key(able, winners, few)
    drawn = up_to(cutoff) & (F.col("n_features") >= min_words) if cutoff else F.lit(False)
    plain = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    if not cutoff:
        return plain.select("doc_id", "n_features", "weight", "score", "rank")
    ranked = rank(scored.filter(drawn), winners)
    return plain.unionByName(ranked).select("doc_id", "n_features", "weight", "score", "rank")


# --- scores ---------------------------------------------------------------------


def crc_table(length: int) -> tuple[np.ndarray, np.ndarray]:
    """What a byte at a distance from the end of a word adds to its CRC-32, and the CRC-32
    of as many zero bytes. CRC-32 is linear: both are combined by exclusive or."""
    zeros = np.array([zlib.crc32(bytes(n)) for n in range(length + 1)], np.uint32)
    added = np.zeros((length, 256), np.uint32)
    for far in range(length):
        for bit in range(8):
            word = bytes([1 << bit]) + bytes(far)
            added[far, 1 << bit] = zlib.crc32(word) ^ int(zeros[far + 1])
        for byte in range(1, 256):
            low = byte & -byte
            if low != byte:
                added[far, byte] = added[far, byte ^ low] ^ added[far, low]
    return added, zeros


_LENGTH = 64
_ADDED, _ZEROS = crc_table(_LENGTH)


def crc_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span; spans ascend, don't overlap and hold a byte at least."""
    sizes = stops - starts
    out = np.zeros(len(starts), np.uint32)
    usual = sizes <= _LENGTH
    for i in np.flatnonzero(~usual):
        out[i] = zlib.crc32(data[starts[i] : stops[i]].tobytes())
    starts, stops, sizes = starts[usual], stops[usual], sizes[usual]
    if len(starts):
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(starts - ends + sizes, sizes)
        far = np.repeat(ends, sizes) - np.arange(int(ends[-1])) - 1
        out[usual] = np.bitwise_xor.reduceat(_ADDED[far, data[at]], ends - sizes) ^ _ZEROS[sizes]
    return out


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = hashing.SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` bytes that end between words, inside long texts too."""
    begin = 0
    while begin < len(data):
        end = min(begin + limit, len(data))
        while end < len(data) and _WORD[data[end - 1]] and _WORD[data[end]]:
            # The word goes on: end after it or with its text.
            ahead = data[end : end + limit]
            gap = np.flatnonzero(~_WORD[ahead])
            stop = end + (int(gap[0]) if len(gap) else len(ahead))
            edge = offsets[min(np.searchsorted(offsets, end), len(offsets) - 1)]
            if edge <= stop:
                end = int(edge)
                break
            end = stop
        yield begin, end
        begin = end


def words(data: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of the words of a block."""
    inside = np.zeros(end - begin + 2, np.int8)
    inside[1:-1] = _WORD[data[begin:end]]
    change = np.diff(inside)
    first, last = change == 1, change == -1
    edges = offsets[np.searchsorted(offsets, begin, "right") : np.searchsorted(offsets, end, "left")] - begin
    cut = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
    first[cut] = last[cut] = True
    return np.flatnonzero(first) + begin, np.flatnonzero(last) + begin


def _buckets(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and bucket of every word, block by block."""
    data, offsets = hashing.text_bytes(texts)
    for begin, end in blocks(data, offsets):
        starts, stops = words(data, offsets, begin, end)
        low = _LOWER[data[begin:end]]
        found = crc_spans(low, starts - begin, stops - begin) % np.uint32(buckets)
        yield np.searchsorted(offsets, starts, "right") - 1, found.astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Words in each bucket over all texts; one number a bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in _buckets(batch.column("text"), buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, from the counts of all and of target words."""
    size, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((y + 1.0) * (s + size) / ((x + 1.0) * (t + size))))
            for x, y in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def weights(rows: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    """``(doc_id, n_features, weight)``: the floored mean gain of a text's words."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for text, found in _buckets(batch.column("text"), buckets):
                if len(text):
                    own, begins = np.unique(text, return_index=True)
                    n[own] += np.diff(np.append(begins, len(text)))
                    total[own] += np.add.reduceat(gain[found], begins)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n), pa.array(total // np.maximum(n, 1))],
                ["doc_id", "n_features", "weight"],
            )

    return rows.mapInArrow(weigh, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


# --- selection --------------------------------------------------------------------


class Key(NamedTuple):
    """Place of a row in the order of the draw: less is better, no two are equal."""

    loss: int
    id: int
    n_features: int
    row: int


def _key() -> Column:
    return F.struct((-F.col("score")).alias("loss"), "id", "n_features", "row")


def _fixed(key: Key) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(Key._fields, key)])


def up_to(key: Key) -> Column:
    return _key() <= _fixed(key)


def _order(keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys.T[::-1])


def _up_to(keys: np.ndarray, key: Key) -> np.ndarray:
    """Which rows of an array of keys don't come after ``key``."""
    out = np.zeros(len(keys), bool)
    equal = np.ones(len(keys), bool)
    for column, value in zip(keys.T, key):
        out |= equal & (column < value)
        equal &= column == value
    return out | equal


def cutoff_key(able: DataFrame, winners: int, few: int = FEW) -> Key | None:
    """The last key of the ``winners`` best, exactly."""
    if winners <= 0:
        return None
    keys = able.select(_key().alias("k")).select("k.*")
    left, place, written = able.count(), winners, None
    low = high = None
    pivot = _weighted_median(_medians(keys, None).collect())
    while left > few:
        found = _medians(_between(keys, low, high), pivot).collect()
        before = [r for r in found if r["side"] == 0]
        after = [r for r in found if r["side"] == 1]
        n = sum(r["n"] for r in before)
        if place <= n:
            high, left, side = pivot, n, before
        else:
            low, left, side, place = pivot, left - n, after, place - n
        if left == 1 and side is before:
            break
        pivot = _weighted_median(side)
        if written is None or left * 8 < written:
            # What remains is written anew now and then, so all rounds together read
            # little more than the first.
            keys, written = materialise(_between(keys, low, high), "remaining"), left
    rest = sorted(Key(*r) for r in _between(keys, low, high).collect())
    return rest[place - 1]


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    """Keys after ``low`` and up to ``high``. The bounds of the first field go to the scan."""
    whole = F.struct(*Key._fields)
    if low:
        keys = keys.filter((F.col("loss") >= low.loss) & (whole > _fixed(low)))
    if high:
        keys = keys.filter((F.col("loss") <= high.loss) & (whole <= _fixed(high)))
    return keys


def _medians(keys: DataFrame, pivot: Key | None) -> DataFrame:
    """Medians of the keys of a task up to the pivot (side 0) and after it (side 1), and
    how many keys each stands for: one row a side and a million keys."""

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.column_stack([np.asarray(batch.column(n), np.int64) for n in Key._fields]))
            size += batch.num_rows
            if size >= KEYS:
                yield from middle(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from middle(np.concatenate(held))

    def middle(some: np.ndarray) -> Iterator[pa.RecordBatch]:
        before = np.ones(len(some), bool) if pivot is None else _up_to(some, pivot)
        for side, part in enumerate((some[before], some[~before])):
            if len(part):
                key = part[_order(part)[(len(part) - 1) // 2]].tolist()
                row = {"side": [side], "n": [len(part)], **{n: [x] for n, x in zip(Key._fields, key)}}
                yield pa.RecordBatch.from_pydict(row)

    fields = ", ".join(f"{n} long" for n in Key._fields)
    return keys.mapInArrow(medians, f"side long, n long, {fields}")


def _weighted_median(medians: list) -> Key:
    """The median at which half of the keys that the medians stand for is reached."""
    ordered = sorted((Key(*(r[n] for n in Key._fields)), r["n"]) for r in medians)
    half, reached = sum(n for _, n in ordered) / 2, 0
    for key, n in ordered:
        reached += n
        if reached >= half:
            return key
    raise ValueError("no keys")


def rank(drawn: DataFrame, winners: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``drawn`` with ``rank``, by range parts sorted each for itself; one number a part
    says where its ranks begin."""
    keys = [F.desc("score"), F.col("id"), F.col("n_features"), F.col("row")]
    ranged = drawn.repartitionByRange(winners // part_rows + 1, *keys)
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return (
        ranged.join(starts, "part")
        .withColumn("rank", F.col("start") + within.cast("long"))
        .select(*drawn.columns, "rank")
    )
