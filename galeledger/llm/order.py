"""Work on rows in ascending order of an integer id, in ranges of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeledger.llm.tables import chunk_count, documents, row_bytes

#: Bytes of text in a range: least and most; between them, as the square root of all.
RANGE_BYTES = 8 << 20, 256 << 20


def range_bounds(rows: DataFrame, ranges: int, id_col: str = "doc_id") -> list[int]:
    """Ids that cut the rows into about ``ranges`` parts of like numbers of rows: one
    number per range, from a quantile sketch, comes to the driver."""
    if ranges <= 1:
        return []
    shares = [k / ranges for k in range(1, ranges)]
    found = rows.select(id_col).approxQuantile(id_col, shares, 1 / (8 * ranges))
    return sorted({min(int(x), (1 << 63) - 1) for x in found})


def range_count(total: int) -> int:
    least, most = RANGE_BYTES
    return chunk_count(total, min(most, max(least, int(25 * total**0.5))))


def range_of(doc_id: np.ndarray, bounds: list[int]) -> np.ndarray:
    return np.searchsorted(np.array(bounds, np.int64), doc_id, side="left").astype(np.int32)


def in_order(
    docs: DataFrame,
    function: Callable[[pa.Table, int], pa.Table],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``function`` on each range of rows, in order of id and text.

    It gets the range's rows and, as one more row, the first row after the range
    (after the last range: the first row of all), and the number of own rows.
    """
    plain = documents(docs, id_col=id_col, text_col=text_col)
    n, total = row_bytes(plain)
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    bounds = range_bounds(plain, range_count(total))
    cuts = np.array(bounds, np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"), np.int64)
            part = range_of(ids, bounds)
            least = np.full(len(cuts) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, part, ids)
            parts = np.unique(part)
            yield pa.record_batch([pa.array(parts), pa.array(least[parts])], ["part", "first"])

    # One row per range: its first id.
    firsts = (
        plain.select("doc_id")
        .mapInArrow(number, "part int, first long")
        .groupBy("part")
        .agg(F.min("first").alias("first"))
        .orderBy("part")
        .collect()
    )
    parts = np.array([r["part"] for r in firsts], np.int32)
    heads = np.array([r["first"] for r in firsts], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"), np.int64)
            own = pa.array(range_of(ids, bounds))
            guest = pa.array(np.zeros(len(ids), bool))
            yield batch.append_column("part", own).append_column("guest", guest)
            at = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, ids), len(heads) - 1)] == ids)
            if len(at):
                before = parts[np.searchsorted(heads, ids[at]) - 1]
                some = batch.take(pa.array(at))
                yield some.append_column("part", pa.array(before)).append_column(
                    "guest", pa.array(np.ones(len(at), bool))
                )

    def run(table: pa.Table) -> pa.Table:
        keys = [("guest", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]
        table = table.sort_by(keys).combine_chunks()
        rows = int(np.count_nonzero(~np.asarray(table["guest"].combine_chunks().to_numpy(zero_copy_only=False))))
        return function(table.slice(0, rows + 1), rows)

    return (
        plain.mapInArrow(route, "doc_id long, text string, part int, guest boolean")
        .groupBy("part")
        .applyInArrow(run, schema)
    )
