"""Relevance verdict of one article as a single column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeledger import schemas
from galeledger.functions.columns import column_function, constant, let, python_round2, strings
from galeledger.functions.text import (
    fold_case_twins,
    raw_whole_words_pattern,
    whole_word_hits,
)
from galeledger.vocab import SHARE_CUTOFF, WEATHER, Vocabulary

# Confidences and reasons of the three early outcomes.
EMPTY = (1.0, "Empty text")
VETOED = (0.8, "Contains non-relevant context")
UNMATCHED = (0.9, "No relevant patterns found")
ONE_CATEGORY = "Weather-related patterns found"
MANY_CATEGORIES = "Multiple weather-related patterns found"

_HIT_CAP = 5  # beyond this many hits the confidence no longer grows


def _confidence(categories: int, hits: int) -> float:
    breadth = min(0.5 + categories * 0.15, 1.0)
    volume = min(0.5 + hits * 0.1, 1.0)
    return round((breadth + volume) / 2, 2)


def confidence_table(n_categories: int) -> list[list[float]]:
    """Every confidence a match can have: row per significant categories, column
    per hits, computed with Python's rounding."""
    return [
        [_confidence(n, m) for m in range(1, _HIT_CAP + 1)]
        for n in range(1, n_categories + 1)
    ]


def _irrelevant(outcome: tuple[float, str]) -> Column:
    confidence, reason = outcome
    verdict = {"relevant": False, "confidence": confidence, "categories": [], "reason": reason}
    return constant(verdict, schemas.VERDICT.simpleString())


def _is_empty(text: Column) -> Column:
    return text.isNull() | (text == "")


def _vetoed(text: Column, folded: Column, vocab: Vocabulary) -> Column:
    if not vocab.negatives:
        return F.lit(False)
    found = F.arrays_overlap(folded, strings(w.lower() for w in vocab.negatives))
    # Only the capital dotted I changes length when lower-cased.
    raw = text.rlike(raw_whole_words_pattern(vocab.negatives))
    return F.when(F.contains(text, F.lit("İ")), raw).otherwise(found)


def _matches_by_category(hits: Column, folded: Column, vocab: Vocabulary) -> Column:
    """Per category the hits of its words, word list order first."""

    def of_word(word: Column) -> Column:
        return F.filter(hits, lambda h, i: folded[i] == word)

    def of_category(words: Column) -> Column:
        found = F.flatten(F.transform(words, of_word))
        return F.when(F.arrays_overlap(folded, words), found).otherwise(strings())

    words = [[w.lower() for w in c.words] for c in vocab.categories]
    return F.transform(constant(words, "array<array<string>>"), of_category)


def _shares(matches: Column, vocab: Vocabulary) -> Column:
    """Score share per category; products and sums in category order as doubles."""
    weights = constant([float(c.weight) for c in vocab.categories], "array<double>")
    scores = F.zip_with(matches, weights, lambda m, w: F.size(m) * w)

    def shares(scores: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda t, s: t + s)
        return let(total, lambda t: F.transform(scores, lambda s: s / t))

    return let(scores, shares)


def _scored(matches: Column, shares: Column, vocab: Vocabulary) -> Column:
    kept = F.size(F.filter(shares, lambda s: s > SHARE_CUTOFF))
    hits = F.aggregate(matches, F.lit(0), lambda n, m: n + F.size(m))
    table = constant(confidence_table(len(vocab.categories)), "array<array<double>>")
    names = strings(c.name for c in vocab.categories)
    categories = F.transform(
        matches,
        lambda m, i: F.struct(
            names[i].alias("name"), python_round2(shares[i]).alias("score"), m.alias("matches")
        ),
    )
    return F.struct(
        F.lit(True).alias("relevant"),
        table[kept - 1][F.least(hits, F.lit(_HIT_CAP)) - 1].alias("confidence"),
        F.filter(categories, lambda c, i: shares[i] > SHARE_CUTOFF).alias("categories"),
        F.when(kept > 1, F.lit(MANY_CATEGORIES)).otherwise(F.lit(ONE_CATEGORY)).alias("reason"),
    )


def _judge(text: Column, hits: Column, vocab: Vocabulary) -> Column:
    def with_matches(matches: Column) -> Column:
        scored = let(_shares(matches, vocab), lambda s: _scored(matches, s, vocab))
        return F.when(F.exists(matches, lambda m: F.size(m) > 0), scored).otherwise(
            _irrelevant(UNMATCHED)
        )

    def with_folded(folded: Column) -> Column:
        return (
            F.when(_vetoed(text, folded, vocab), _irrelevant(VETOED))
            .when(F.size(hits) == 0, _irrelevant(UNMATCHED))
            .otherwise(let(_matches_by_category(hits, folded, vocab), with_matches))
        )

    return let(F.transform(hits, lambda h: fold_case_twins(h, vocab.all_words)), with_folded)


@column_function
def verdict(text: Column, vocab: Vocabulary = WEATHER) -> Column:
    """Is the text about severe-weather effects, how surely, and why.

    An empty text is decided first, then a vetoing word, then the keyword
    scores. The text is scanned once for all words of all categories.
    """

    def judge(low: Column) -> Column:
        return let(
            whole_word_hits(low, vocab.all_words), lambda hits: _judge(text, hits, vocab)
        )

    return F.when(_is_empty(text), _irrelevant(EMPTY)).otherwise(let(F.lower(text), judge))


@column_function
def is_relevant(text: Column, vocab: Vocabulary = WEATHER) -> Column:
    """Just the yes or no of :func:`verdict`."""
    return verdict(text, vocab)["relevant"]
