"""Summaries of judged and classified articles.

Each report is one grouped aggregation over few distinct keys, combined
map-side, so a frequent place or category does not load one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeledger.functions.columns import python_round2
from galeledger.operators.order import by_count
from galeledger.operators.relevance import passes
from galeledger.vocab import (
    BORDERLINE,
    BORDERLINE_ROWS,
    DEFAULT_MIN_CONFIDENCE,
    MAX_ARTICLES_DROPPED,
    MAX_PERCENT_DROPPED,
    THRESHOLDS,
    TOP_LOCATIONS,
)


def _rate(relevant: Column, total: Column) -> Column:
    return python_round2(F.try_divide(relevant, total) * 100)


def run_summary(judged: DataFrame, min_confidence: float = DEFAULT_MIN_CONFIDENCE) -> DataFrame:
    """One row: articles, relevant articles, percentage and threshold; no
    percentage when there are no articles."""
    counts = judged.agg(
        F.count("*").alias("total_articles"),
        F.count_if(passes(F.col("relevance"), min_confidence)).alias("relevant_articles"),
    )
    return counts.select(
        "total_articles",
        "relevant_articles",
        _rate(F.col("relevant_articles"), F.col("total_articles")).alias("relevance_rate"),
        F.lit(float(min_confidence)).alias("confidence_threshold"),
    )


def stored_summary(
    articles: DataFrame, results: DataFrame, min_confidence: float = DEFAULT_MIN_CONFIDENCE
) -> DataFrame:
    """The same row, stamped, from finished results: nothing is judged again.

    Both counts are taken of tables, so a lost executor cannot skew them.
    """
    counts = articles.select(F.lit(1).alias("a"), F.lit(0).alias("r")).unionAll(
        results.select(F.lit(0).alias("a"), F.lit(1).alias("r"))
    ).agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("total_articles"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("relevant_articles"),
    )
    return counts.select(
        "total_articles",
        "relevant_articles",
        _rate(F.col("relevant_articles"), F.col("total_articles")).alias("relevance_rate"),
        F.current_timestamp().alias("processing_date"),
        F.lit(float(min_confidence)).alias("confidence_threshold"),
    )


def location_frequency(results: DataFrame, limit: int | None = TOP_LOCATIONS) -> DataFrame:
    """Articles per place, most mentioned first."""
    places = results.select(F.explode("classification.locations").alias("place"))
    counts = places.groupBy(F.col("place.name").alias("name")).count()
    return by_count(counts, "name", limit)


def damage_distribution(results: DataFrame) -> DataFrame:
    """Articles per damage type, most frequent first."""
    damage = results.select(F.explode("classification.damage_types").alias("damage"))
    counts = damage.groupBy(F.col("damage.type").alias("type")).count()
    return by_count(counts, "type")


# --- choosing a confidence threshold -------------------------------------------


def threshold_buckets(
    scores: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    confidence: str | Column = "relevance.confidence",
    relevant: str | Column = "relevance.relevant",
) -> DataFrame:
    """``(threshold, articles, mean_confidence)``: relevant articles reaching each
    threshold. All thresholds are counted in one pass and none is left out."""
    confidence = F.col(confidence) if isinstance(confidence, str) else confidence
    relevant = F.col(relevant) if isinstance(relevant, str) else relevant
    kept = scores.filter(relevant).select(confidence.alias("c"))
    levels = sorted(float(t) for t in thresholds)
    aggregates = []
    for i, t in enumerate(levels):
        aggregates.append(F.count_if(F.col("c") >= t).alias(f"n{i}"))
        aggregates.append(F.avg(F.when(F.col("c") >= t, F.col("c"))).alias(f"m{i}"))
    rows = [
        F.struct(
            F.lit(t).alias("threshold"),
            F.col(f"n{i}").alias("articles"),
            F.col(f"m{i}").alias("mean_confidence"),
        )
        for i, t in enumerate(levels)
    ]
    return kept.agg(*aggregates).select(F.inline(F.array(*rows)))


def threshold_categories(
    judged: DataFrame, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """``(threshold, name, count)``: how many articles reaching a threshold have
    each significant category."""
    levels = sorted(float(t) for t in thresholds)
    named = judged.filter("relevance.relevant").select(
        F.col("relevance.confidence").alias("c"),
        F.explode("relevance.categories.name").alias("name"),
    )
    counts = named.groupBy("name").agg(
        *[F.count_if(F.col("c") >= t).alias(f"n{i}") for i, t in enumerate(levels)]
    )
    rows = [
        F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("count"))
        for i, t in enumerate(levels)
    ]
    return (
        counts.select("name", F.inline(F.array(*rows)))
        .filter("count > 0")
        .select("threshold", "name", "count")
        .orderBy("threshold", F.desc("count"), "name")
    )


def borderline_sample(
    judged: DataFrame,
    low: float = BORDERLINE[0],
    high: float = BORDERLINE[1],
    rows: int = BORDERLINE_ROWS,
) -> DataFrame:
    """The first relevant articles, by date and url, with a middling confidence."""
    return (
        judged.filter(
            F.col("relevance.relevant") & F.col("relevance.confidence").between(low, high)
        )
        .orderBy(F.col("date").asc_nulls_first(), "url")
        .limit(rows)
        .select(
            "url",
            F.col("relevance.confidence").alias("confidence"),
            F.col("relevance.categories.name").alias("categories"),
        )
    )


def threshold_drops(buckets: DataFrame) -> DataFrame:
    """Articles lost by raising the threshold one step, per step.

    The window has no partition because ``buckets`` has a row per threshold.
    """
    step = Window.orderBy("threshold")
    dropped = F.col("articles") - F.col("next_articles")
    return (
        buckets.withColumn("next_threshold", F.lead("threshold").over(step))
        .withColumn("next_articles", F.lead("articles").over(step))
        .filter("next_threshold IS NOT NULL")
        .select(
            F.col("threshold").alias("from_threshold"),
            F.col("next_threshold").alias("threshold"),
            dropped.alias("articles_dropped"),
            F.coalesce(F.try_divide(dropped, F.col("articles")) * 100, F.lit(0.0)).alias(
                "percentage_dropped"
            ),
            F.col("next_articles").alias("articles_left"),
        )
    )


def recommend_threshold(
    drops: DataFrame,
    max_percent: float = MAX_PERCENT_DROPPED,
    max_articles: int = MAX_ARTICLES_DROPPED,
) -> DataFrame:
    """The first step that loses little, else the first step."""
    harmful = ~(
        (F.col("percentage_dropped") < max_percent) & (F.col("articles_dropped") < max_articles)
    )
    best = F.min(
        F.struct(
            harmful.alias("harmful"),
            "threshold",
            "articles_dropped",
            "percentage_dropped",
            "articles_left",
        )
    )
    return drops.agg(best.alias("b")).select(
        "b.threshold", "b.articles_dropped", "b.percentage_dropped", "b.articles_left"
    )
