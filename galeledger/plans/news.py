"""News jobs: classify a corpus, report on the results, tune the threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeledger.functions.relevance import verdict
from galeledger.operators import prepare, reports
from galeledger.operators.classify import classify_articles, classify_gated
from galeledger.operators.joins import anti_natural, left_by_url, rows_with_url_in, semi_by_url
from galeledger.operators.order import rows_at, sort_by_date
from galeledger.operators.places import with_other_names
from galeledger.operators.relevance import passes, with_verdict
from galeledger.session import materialise
from galeledger.sources.files import (
    read_archive_contents,
    read_articles,
    read_csv,
    read_results,
    read_summary,
    read_transcripts,
    write_csv,
    write_json,
)
from galeledger.vocab import (
    DEFAULT_MIN_CONFIDENCE,
    SAMPLE_POSITIONS,
    THRESHOLDS,
    WEATHER,
    Vocabulary,
)


def process_news(
    spark: SparkSession,
    articles_path: str,
    output_path: str,
    min_confidence: float = DEFAULT_MIN_CONFIDENCE,
    fmt: str = "json",
    place_names: DataFrame | None = None,
) -> None:
    """Write the relevant articles, classified and sorted by date, and a summary.

    ``place_names`` optionally lists further places to look for. Each text is
    judged once: the sort and the summary work on what was written.
    """
    judged = with_verdict(read_articles(spark, articles_path, fmt))
    passed = passes(F.col("relevance"), min_confidence)
    # The corpus is read once: every article leaves a row, texts stay where they are
    # needed further on.
    kept = F.when(F.col("passed"), F.col("text")).alias("text")
    judged = materialise(
        judged.withColumn("passed", passed).select("date", "url", "relevance", "passed", kept),
        "judged",
    )
    gated = judged.filter("passed").drop("passed")
    others = None
    if place_names is not None:
        others = "other_names"
        gated = with_other_names(gated, place_names, name=others)
    results = sort_by_date(classify_gated(gated, others=others))
    write_json(results, f"{output_path}/results")
    summary = reports.stored_summary(judged, judged.filter("passed"), min_confidence)
    write_json(summary.coalesce(1), f"{output_path}/summary")


def process_ungated(spark: SparkSession, articles_path: str, fmt: str = "json") -> DataFrame:
    """Classification of every article of a file, relevant or not."""
    return classify_articles(read_articles(spark, articles_path, fmt))


def analyze_results(spark: SparkSession, output_path: str) -> dict[str, DataFrame]:
    """Reports on a finished run: summary, top locations, damage distribution."""
    results = read_results(spark, output_path)
    return {
        "summary": read_summary(spark, output_path),
        "locations": reports.location_frequency(results),
        "damage_types": reports.damage_distribution(results),
    }


def analyze_thresholds(
    articles: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    vocab: Vocabulary = WEATHER,
) -> dict[str, DataFrame]:
    """Effect of each confidence threshold, a borderline sample, a recommendation.

    All reports read one stored table of verdicts, without the texts.
    """
    judged = materialise(
        articles.select("date", "url", verdict("text", vocab).alias("relevance")),
        "verdicts",
    )
    buckets = materialise(reports.threshold_buckets(judged, thresholds), "buckets")
    drops = reports.threshold_drops(buckets)
    return {
        "buckets": buckets,
        "categories": reports.threshold_categories(judged, thresholds),
        "borderline": reports.borderline_sample(judged),
        "drops": drops,
        "recommendation": reports.recommend_threshold(drops),
    }


def build_corpus(
    spark: SparkSession, contents_path: str, transcripts_path: str, output_path: str
) -> DataFrame:
    """Write the article corpus of landed archive and transcript responses."""
    articles = prepare.corpus(
        read_archive_contents(spark, contents_path),
        read_transcripts(spark, transcripts_path),
    )
    write_json(articles, output_path)
    return read_articles(spark, output_path, "jsonl")


def export_archive(spark: SparkSession, contents_path: str, output_path: str, fmt: str = "json") -> DataFrame:
    """Write the records of all landed months, with all their fields, as JSON and CSV."""
    records = materialise(read_archive_contents(spark, contents_path, None, fmt), "archive")
    write_json(records, f"{output_path}/json")
    write_csv(records, f"{output_path}/csv")
    return records


def check_filter(
    spark: SparkSession,
    archive_csv: str,
    filtered_csv: str,
    columns: Sequence[str] = ("url",),
    multiline: bool | None = None,
) -> dict[str, DataFrame]:
    """A filter's output against the archive, both as CSV files with a ``url`` column.

    ``found``: archive records whose url was filtered; ``joined``: every filtered row
    with its archive record; ``unlike``: filtered rows without an equal archive record
    in all shared columns; ``missed``: the chosen columns of the archive records with
    the urls of these. ``multiline`` as in :func:`galeledger.sources.files.read_csv`.
    """
    archive = read_csv(spark, archive_csv, None, multiline)
    filtered = read_csv(spark, filtered_csv, None, multiline)
    unlike = anti_natural(filtered, archive)
    more = archive.select("url", *[F.col(c).alias(f"archive_{c}") for c in archive.columns if c != "url"])
    return {
        "found": semi_by_url(archive, filtered),
        "joined": left_by_url(filtered, more),
        "unlike": unlike,
        "missed": rows_with_url_in(archive, unlike, *columns),
    }


def write_sample(
    articles: DataFrame, output_path: str, positions: Sequence[int] = SAMPLE_POSITIONS
) -> None:
    """Write the sample corpus as JSON."""
    write_json(sample_corpus(articles, positions).coalesce(1), output_path)


def sample_corpus(
    articles: DataFrame, positions: Sequence[int] = SAMPLE_POSITIONS
) -> DataFrame:
    """Articles at fixed positions among those about weather, by date and url."""
    return rows_at(prepare.keyword_prefilter(articles), positions, "date", "url")
