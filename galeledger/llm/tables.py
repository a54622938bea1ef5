"""Sizes and intermediate tables of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeledger.session import materialise

__all__ = ["ascending", "chunk_count", "documents", "materialise", "packed", "row_bytes"]

#: A missing id counts as the greatest one.
_LAST = (1 << 63) - 1


def documents(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) under these names, and ``more`` columns."""
    return docs.select(
        ascending(F.col(id_col)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *more,
    )


def packed(docs: DataFrame) -> Column:
    """The columns of ``docs`` in one struct ``row``, out of reach of other names."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def ascending(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def row_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, by one aggregate over the table."""
    row = docs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")
    ).first()
    return row["n"], row["bytes"] or 0


def chunk_count(total: int, each: int) -> int:
    return max(1, -(-total // each))
