"""Orderings, limits and row positions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeledger.functions.columns import constant
from galeledger.session import materialise


SORT_BYTES = 128 * 1024 * 1024


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that was just read, from their listing."""
    files = df.inputFiles()
    if not files:
        return 0
    folder = files[0].rpartition("/")[0]
    listed = df.sparkSession.read.format("binaryFile").load(folder)
    return listed.agg(F.sum("length")).first()[0] or 0


def sort_by_date(results: DataFrame, part_bytes: int = SORT_BYTES) -> DataFrame:
    """Results by date, missing dates first, then by url, then in input order.

    The range sort samples its input before shuffling it, so the input is
    written out first, the texts are judged once, and its size gives the number of
    sorted parts. Input order as last key also lets copies of one article spread over
    several sorted partitions.
    """
    keyed = results.withColumn("__row", F.monotonically_increasing_id())
    written = materialise(keyed, "unsorted")
    keys = [F.col("date").asc_nulls_first(), F.col("url"), F.col("__row")]
    parts = file_bytes(written) // part_bytes + 1
    return written.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__row")


def by_count(counts: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Most frequent first, ties by name."""
    ordered = counts.orderBy(F.desc("count"), name)
    return ordered if limit is None else ordered.limit(limit)


#: Different keys in a part of an order, about.
PART_KEYS = 1 << 21
_DIGEST = "__digest"


def rows_at(rows: DataFrame, positions: Sequence[int], *order: str) -> DataFrame:
    """Rows at 1-based positions of the given order, missing keys first; rows with equal
    keys are ordered by a digest of the whole row, so copies stand for each other.

    Positions are counted on the different keys alone, which Spark counts, cuts into
    ranges of measured size and numbers; a key and a number for each position come to the
    driver. The rows themselves are not moved: they are read again where they have one of
    these keys, which the sources get as a filter. ``rows`` must give the same rows when
    read again.
    """
    counts = materialise(rows.groupBy(*order).agg(F.count(F.lit(1)).alias("__n")), "keys")
    found = _keys_at(counts, sorted(set(positions)), order)
    alone = [key for key, n, _ in found if n == 1]
    out = rows.filter(_any_of(alone, order))
    for key, n, places in found:
        if n > 1:
            out = out.unionByName(_tied(rows.filter(_any_of([key], order)), places, order))
    # At most one row a position, in order.
    return out.orderBy(*order).limit(max(1, len(set(positions))))


def _any_of(keys: Sequence[tuple], order: Sequence[str]) -> Column:
    """Whether a row has one of the keys."""
    same = [reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(order, key)]) for key in keys]
    return reduce(or_, same, F.lit(False))


def _tied(rows: DataFrame, places: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Rows at some places among those of one key."""
    if _DIGEST not in rows.columns:
        whole = F.to_json(F.struct(*[rows[f"`{c}`"] for c in rows.columns]))
        return rows_at(rows.withColumn(_DIGEST, F.sha2(whole, 256)), places, _DIGEST).drop(_DIGEST)
    # Equal digests: any of the copies will do, as often as it is asked for.
    one = rows.dropDuplicates([_DIGEST])
    return one.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(places)))).alias("__copy")).drop("__copy")


def _keys_at(counts: DataFrame, wanted: Sequence[int], order: Sequence[str]) -> list[tuple[tuple, int, list[int]]]:
    """Keys at positions: the key, how many rows have it, and which of them are wanted."""
    if not wanted:
        return []
    listed = constant([int(p) for p in wanted], "array<bigint>")
    parts = counts.count() // PART_KEYS + 1
    if parts == 1:
        starts = counts.select("*", F.lit(0).alias("__part"), F.lit(0).alias("__start"))
    else:
        ranged = counts.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
        ranged = materialise(ranged, "ranged")
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = ranged.groupBy("__part").agg(F.sum("__n").alias("__rows")).select(
            "__part", "__rows", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
        )
        # Only parts that hold a wanted position are sorted.
        some = sizes.filter(
            F.exists(listed, lambda p: (p > F.col("__start")) & (p <= F.col("__start") + F.col("__rows")))
        )
        starts = ranged.join(some.select("__part", "__start"), "__part")
    up_to = F.sum("__n").over(Window.partitionBy("__part").orderBy(*order))
    ended = starts.withColumn("__end", F.col("__start") + up_to)
    first = F.col("__end") - F.col("__n")
    inside = F.filter(listed, lambda p: (p > first) & (p <= F.col("__end")))
    hits = ended.select(*order, "__n", F.transform(inside, lambda p: p - first).alias("__places"))
    rows = hits.filter("size(__places) > 0").collect()
    return [(tuple(r[c] for c in order), r["__n"], r["__places"]) for r in rows]
