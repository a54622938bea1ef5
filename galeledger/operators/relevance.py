"""Relevance verdict and gate over article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeledger.functions.columns import once
from galeledger.functions.relevance import verdict
from galeledger.vocab import DEFAULT_MIN_CONFIDENCE, WEATHER, Vocabulary


def with_verdict(
    articles: DataFrame,
    vocab: Vocabulary = WEATHER,
    text: str = "text",
    name: str = "relevance",
) -> DataFrame:
    """Add the verdict struct as a column; each text is scanned once however the
    verdict is filtered and used."""
    return articles.select("*", once(verdict(text, vocab), name))


def passes(relevance: Column, min_confidence: float = DEFAULT_MIN_CONFIDENCE) -> Column:
    """Relevant with at least the given confidence."""
    return relevance["relevant"] & (relevance["confidence"] >= min_confidence)


def relevance_gate(
    articles: DataFrame,
    min_confidence: float = DEFAULT_MIN_CONFIDENCE,
    vocab: Vocabulary = WEATHER,
) -> DataFrame:
    """Articles that pass, with their verdict in ``relevance``."""
    return with_verdict(articles, vocab).filter(passes(F.col("relevance"), min_confidence))


def relevant_only(articles: DataFrame, vocab: Vocabulary = WEATHER) -> DataFrame:
    """Articles judged relevant, whatever the confidence."""
    return with_verdict(articles, vocab).filter("relevance.relevant").drop("relevance")
