"""Appending tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def concat_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """Pages of one schema in one table, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), pages)


def bind_rows(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; a column missing from a table is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
