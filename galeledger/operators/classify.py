"""Classified articles: the gated and the ungated corpus job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeledger.functions.columns import once
from galeledger.functions.events import PARTS, classification
from galeledger.operators.relevance import relevance_gate
from galeledger.vocab import (
    DAMAGE_PHRASES,
    DEFAULT_MIN_CONFIDENCE,
    GAZETTEER,
    SEVERITY,
    WEATHER,
    DamagePhrase,
    Place,
    SeverityRules,
    Vocabulary,
)


def _classification(gazetteer, rules, phrases, others: str | None, parts) -> Column:
    others = F.col(others) if others else None
    value = classification("text", gazetteer, rules, phrases, others, tuple(parts))
    return once(value, "classification")


def classify_articles(
    articles: DataFrame,
    gazetteer: Sequence[Place] = GAZETTEER,
    rules: SeverityRules = SEVERITY,
    phrases: Sequence[DamagePhrase] = DAMAGE_PHRASES,
    others: str | None = None,
    parts: Sequence[str] = PARTS,
) -> DataFrame:
    """Every article with its places, severity and damage types, relevant or not.

    ``others`` names a column of further place names; ``parts`` chooses what is
    extracted.
    """
    return articles.select(
        "date", "url", _classification(gazetteer, rules, phrases, others, parts)
    )


def classify_gated(
    gated: DataFrame,
    gazetteer: Sequence[Place] = GAZETTEER,
    rules: SeverityRules = SEVERITY,
    phrases: Sequence[DamagePhrase] = DAMAGE_PHRASES,
    others: str | None = None,
    parts: Sequence[str] = PARTS,
) -> DataFrame:
    """Results of articles that passed the gate: verdict and classification."""
    return gated.select(
        "date", "url", "relevance", _classification(gazetteer, rules, phrases, others, parts)
    )


def gated_articles(
    articles: DataFrame,
    min_confidence: float = DEFAULT_MIN_CONFIDENCE,
    vocab: Vocabulary = WEATHER,
    gazetteer: Sequence[Place] = GAZETTEER,
    rules: SeverityRules = SEVERITY,
    phrases: Sequence[DamagePhrase] = DAMAGE_PHRASES,
    others: str | None = None,
    parts: Sequence[str] = PARTS,
) -> DataFrame:
    """Relevant articles with verdict and classification, in no order.

    One narrow stage; the extraction runs on articles that passed the gate.
    """
    gated = relevance_gate(articles, min_confidence, vocab)
    return classify_gated(gated, gazetteer, rules, phrases, others, parts)
