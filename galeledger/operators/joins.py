"""Joins between article tables.

No join here asks for a broadcast: the optimizer broadcasts a side whose size it
knows to be small and otherwise shuffles, with adaptive execution splitting hot
keys of the left side. Right sides of semi and anti joins are reduced to
distinct keys first (see :func:`per_key`), so copies never pile up there.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F


def per_key(rows: DataFrame, *keys: str) -> GroupedData:
    """Group by keys to get one row per key as the right side of a join.

    Adaptive execution splits a hot key only if both sides of the join come
    straight from their own exchange. Grouped by the bare key, the right side
    would keep the partitioning of the grouping and have none; the key is
    therefore wrapped. Unwrap it with ``select("key.*", ...)``.
    """
    return rows.groupBy(F.struct(*keys).alias("key"))


def distinct_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The different keys, as the right side of a join."""
    return per_key(rows, *keys).agg(F.lit(1)).select("key.*")


def left_by_url(left: DataFrame, right: DataFrame, on: str = "url") -> DataFrame:
    """All left rows with the matching right columns.

    Adaptive execution can split both sides of an inner join but only the left side of a
    left join, so left rows without a match, which need only the distinct right keys,
    are found apart. A key that is hot on either side is split.
    """
    matched = left.join(right, on)
    alone = left.join(distinct_keys(right, on), on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def semi_by_url(left: DataFrame, right: DataFrame, on: str = "url") -> DataFrame:
    """Left rows whose key occurs on the right."""
    return left.join(distinct_keys(right, on), on, "left_semi")


def anti_natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows without an equal right row, comparing every shared column.

    Missing values equal each other.
    """
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    renamed = right.select(*[right[c].alias(f"__{c}") for c in shared])
    keys = distinct_keys(renamed, *renamed.columns)
    same = reduce(and_, [left[c].eqNullSafe(keys[f"__{c}"]) for c in shared])
    return left.join(keys, same, "left_anti")


def rows_with_url_in(rows: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns of the rows whose url is in the other table."""
    return semi_by_url(rows, other).select(*(columns or rows.columns))
