"""Filters of bounded size that tell which keys a join can't find.

A key sets two bits of a field; a value whose bits aren't both set is not among the
keys. What passes still has to be joined, so the results don't depend on the filter,
only the rows that are shuffled for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeledger.functions.text import bit_test

#: Most bits of a filter (128 KB, which every task gets), and bits for each key.
MOST_BITS = 1 << 20
KEY_BITS = 16
#: A filter with more of its bits set is not worth asking.
FULL = 0.9


def _spots(hashed: Column, bits: int) -> tuple[Column, Column]:
    """Two numbers below ``bits`` from one hash."""
    mask = F.lit(bits - 1).cast("long")
    return hashed.bitwiseAND(mask), F.shiftrightunsigned(hashed, 32).bitwiseAND(mask)


def filter_bits(keys: int, most: int = MOST_BITS) -> int:
    """Bits for a filter of so many keys: a power of two, 512 bytes at least."""
    return min(most, 1 << max(12, (KEY_BITS * keys - 1).bit_length()))


def key_filter(keys: DataFrame, column: str, most: int = MOST_BITS) -> Callable[[Column], Column]:
    """A test that is true for all values of a column, and false for most others.

    The number of keys is measured and sets the size of the filter, up to ``most`` bits. The
    bits are gathered by Spark; at most ``most / 64`` numbers come to the driver and go into
    the plan as one literal. If the keys are too many for that, the test is always true.
    """
    known = hash_filter(keys.select(F.xxhash64(column).alias("hash")), "hash", most)
    return lambda value: known(F.xxhash64(value))


def hash_filter(keys: DataFrame, column: str, most: int = MOST_BITS) -> Callable[[Column], Column]:
    """As :func:`key_filter` for a column that holds 64-bit hashes."""
    bits = filter_bits(keys.count(), most)
    spot = F.col("spot")
    word = F.floor(spot / 64).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))
    found = (
        keys.select(F.explode(F.array(*_spots(F.col(column), bits))).alias("spot"))
        .groupBy(word.alias("word"))
        .agg(F.bit_or(bit).alias("set"))
        .collect()
    )
    words = [0] * (bits // 64)
    for row in found:
        words[row["word"]] = row["set"]
    if sum((w & (1 << 64) - 1).bit_count() for w in words) > FULL * bits:
        return lambda value: F.lit(True)
    is_set = bit_test(words)

    def known(hashed: Column) -> Column:
        # The second bit is looked up only where the first is set.
        first, second = _spots(hashed, bits)
        return is_set(first) & is_set(second)

    return known
