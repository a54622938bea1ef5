"""Corpus preparation: from archive records and transcripts to articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeledger.functions.columns import let, once
from galeledger.functions.text import mentions_any, quote
from galeledger.operators.joins import per_key
from galeledger.session import materialise
from galeledger.vocab import HEADING_PREFIX, PREFILTER_STEMS


def strip_prefix(heading: Column, pattern: str = HEADING_PREFIX) -> Column:
    """Remove the leading programme name from a heading."""
    return F.regexp_replace(heading, f"(?U){pattern}", "")


def to_article_date(date: Column) -> Column:
    """Date part of a date or timestamp, typed or ISO text; null if malformed."""
    return date.try_cast("date")


def assemble_transcript(segments: Column) -> Column:
    """Segment texts of ``array<struct<content>>`` in array order, one per line."""
    return F.array_join(F.transform(segments, lambda s: s["content"]), "\n")


def unite(*parts: Column, sep: str = "\n") -> Column:
    """Join the parts that are present."""
    return F.concat_ws(sep, *parts)


def attach_transcripts(
    contents: DataFrame, transcripts: DataFrame, latest: Sequence[str] | None = None
) -> DataFrame:
    """Give each archive record the transcript of its ``url``.

    Of several transcripts of a url the greatest by the columns ``latest`` counts
    (default: ``landed``, if the table has it) among those that are not null, ties by a
    digest of the text; equal rows count as one. So the result has exactly the rows of
    ``contents``, whatever order the transcripts come in.

    The transcripts are read once and written to the shared folder, where each row has a
    number that stays the same however often a task is run. The choice is made on the
    keys alone. The texts are shuffled once, for the join on url and chosen row, where a
    hot url on the archive side is split.
    """
    if latest is None:
        latest = [c for c in ("landed",) if c in transcripts.columns]
    rank = F.struct(
        *latest, F.unhex(F.sha2("transcript", 256)).alias("digest"), F.monotonically_increasing_id().alias("row")
    )
    texts = transcripts.filter("transcript IS NOT NULL").select("url", "transcript", rank.alias("__rank"))
    texts = materialise(texts, "transcripts")
    chosen = per_key(texts, "url").agg(F.max("__rank").alias("__rank")).select("key.*", "__rank")
    records = contents.join(chosen, "url", "left")
    return records.join(texts, ["url", "__rank"], "left").drop("__rank")


def corpus(
    contents: DataFrame, transcripts: DataFrame, latest: Sequence[str] | None = None
) -> DataFrame:
    """Articles ``(date, url, text)`` from archive records and transcripts."""
    joined = attach_transcripts(
        contents.select("date", "heading", "lead", "url"), transcripts, latest
    )
    return joined.select(
        to_article_date(F.col("date")).alias("date"),
        "url",
        unite(strip_prefix(F.col("heading")), F.col("lead"), F.col("transcript")).alias("text"),
    )


def keyword_prefilter(
    articles: DataFrame, stems: Sequence[str] = PREFILTER_STEMS, column: str = "text"
) -> DataFrame:
    """Articles whose text contains a stem in any letter case.

    The pattern search runs only on texts the cheap test lets through.
    """
    text = F.col(column)
    likely = let(F.lower(text), lambda low: mentions_any(low, stems))
    match = likely & text.rlike("(?iU)" + "|".join(map(quote, stems)))
    return articles.select("*", once(match, "__match")).filter("__match").drop("__match")
