"""Relevance queries: verdict, gate, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeledger.functions.relevance import (
    EMPTY,
    MANY_CATEGORIES,
    ONE_CATEGORY,
    UNMATCHED,
    VETOED,
    is_relevant,
)
from galeledger.operators import reports
from galeledger.operators.relevance import relevance_gate, relevant_only, with_verdict
from galeledger.vocab import WEATHER, Category, Vocabulary
from workload.inputs import ARTICLES, articles, documents, table

# Words of the driver's own texts, with phrases that overlap single words.
PROSE = Vocabulary(
    categories=(
        Category("articles", ("the", "of the", "thing", "la", "der"), 1.0),
        Category("verbs", ("is", "was", "be", "ist", "was the"), 1.0),
        Category("links", ("and", "that", "and the", "und"), 0.8),
        Category("rare", ("que", "les", "für"), 0.6),
    ),
    negatives=("thanedble", "die"),
)

EVENT_LEVELS = (0.01, 0.05, 0.1, 0.2, 0.4)

# --- Spark ------------------------------------------------------------------


def _verdict_columns(judged: DataFrame) -> DataFrame:
    return judged.select(
        "doc_id",
        F.col("relevance.relevant").alias("relevant"),
        F.col("relevance.confidence").alias("confidence"),
        F.array_join("relevance.categories.name", ",").alias("categories"),
        F.col("relevance.reason").alias("reason"),
    )


def _category_rows(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", F.inline("relevance.categories")).select(
        "doc_id",
        "name",
        "score",
        F.size("matches").cast("bigint").alias("hits"),
        F.array_join("matches", "|").alias("matches"),
    )


def relevance_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict_columns(with_verdict(articles(spark, sf_dir)))


def relevance_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _category_rows(with_verdict(articles(spark, sf_dir)))


def prose_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdict_columns(with_verdict(documents(spark, sf_dir), PROSE))


def prose_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _category_rows(with_verdict(documents(spark, sf_dir), PROSE))


def negative_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_verdict(documents(spark, sf_dir), PROSE)
    return judged.filter("relevance.reason = 'Contains non-relevant context'").select(
        "doc_id", F.col("relevance.confidence").alias("confidence")
    )


def empty_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_verdict(articles(spark, sf_dir))
    return judged.groupBy(F.col("relevance.reason").alias("reason")).agg(
        F.count("*").alias("articles"),
        F.min("relevance.confidence").alias("lowest"),
        F.max("relevance.confidence").alias("highest"),
    )


def relevance_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance_gate(articles(spark, sf_dir), 0.7).select(
        "doc_id", F.col("relevance.confidence").alias("confidence")
    )


def relevant_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevant_only(articles(spark, sf_dir)).select("doc_id", "url")


def is_relevant_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", is_relevant("text", PROSE).alias("relevant")
    )


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: articles and hits per significant category past the gate."""
    gated = relevance_gate(documents(spark, sf_dir), 0.65, PROSE)
    rows = gated.select(F.col("relevance.confidence").alias("c"), F.inline("relevance.categories"))
    return rows.groupBy("name").agg(
        F.count("*").alias("articles"),
        F.sum(F.size("matches")).cast("bigint").alias("hits"),
        F.round(F.avg("score"), 6).alias("mean_share"),
        F.round(F.avg("c"), 6).alias("mean_confidence"),
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_summary(with_verdict(articles(spark, sf_dir)), 0.65)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdict(articles(spark, sf_dir)).select("date", "url", "relevance")


def _rounded(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("mean_confidence", F.round("mean_confidence", 6))


def threshold_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.threshold_buckets(_judged(spark, sf_dir)))


def threshold_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threshold_categories(_judged(spark, sf_dir))


def borderline_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = reports.borderline_sample(_judged(spark, sf_dir))
    return sample.withColumn("categories", F.array_join("categories", ","))


def threshold_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = reports.threshold_drops(reports.threshold_buckets(_judged(spark, sf_dir)))
    return drops.withColumn("percentage_dropped", F.round("percentage_dropped", 6))


def threshold_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = reports.recommend_threshold(
        reports.threshold_drops(reports.threshold_buckets(_judged(spark, sf_dir)))
    )
    return best.withColumn("percentage_dropped", F.round("percentage_dropped", 6))


def _event_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threshold_buckets(
        table(spark, sf_dir, "events"),
        EVENT_LEVELS,
        F.col("value") / 500,
        F.col("event_type") != "error",
    )


def event_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_event_buckets(spark, sf_dir))


def event_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = reports.threshold_drops(_event_buckets(spark, sf_dir))
    return drops.withColumn("percentage_dropped", F.round("percentage_dropped", 6))


def event_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = reports.recommend_threshold(
        reports.threshold_drops(_event_buckets(spark, sf_dir)), 50.0, 1_000_000_000
    )
    return best.withColumn("percentage_dropped", F.round("percentage_dropped", 6))


QUERIES = {
    "relevance_verdict": relevance_verdict,
    "relevance_categories": relevance_categories,
    "prose_verdict": prose_verdict,
    "prose_categories": prose_categories,
    "negative_context": negative_context,
    "empty_guard": empty_guard,
    "relevance_gate": relevance_gate_query,
    "relevant_articles": relevant_articles,
    "is_relevant": is_relevant_query,
    "category_report": category_report,
    "run_summary": run_summary,
    "threshold_buckets": threshold_buckets,
    "threshold_categories": threshold_categories,
    "borderline_sample": borderline_sample,
    "threshold_drop": threshold_drop,
    "threshold_recommend": threshold_recommend,
    "event_threshold_buckets": event_buckets,
    "event_threshold_drop": event_drop,
    "event_threshold_recommend": event_recommend,
}

# --- SQL --------------------------------------------------------------------

_SEP = r"[^\p{L}\p{N}_]"


def _count(word: str) -> str:
    """Whole-word hits in text whose separators are doubled, so that a separator
    between two hits serves both."""
    doubled = word.replace(" ", "  ")
    return f"coalesce(len(regexp_extract_all(p, '{_SEP}{doubled}{_SEP}')), 0)"


def verdict_sql(source: str, vocab: Vocabulary) -> str:
    """CTEs ending in ``v``: one row per article with hits, shares and verdict."""
    cats = list(enumerate(vocab.categories))
    counts = ", ".join(
        f"{_count(w)} AS w{i}_{j}" for i, c in cats for j, w in enumerate(c.words)
    )
    negative = "|".join(w.replace(" ", "  ") for w in vocab.negatives)
    hits = ", ".join(
        "{} AS h{}".format(" + ".join(f"w{i}_{j}" for j in range(len(c.words))), i)
        for i, c in cats
    )
    scores = ", ".join(f"h{i} * {c.weight}::DOUBLE AS s{i}" for i, c in cats)
    total = " + ".join(f"s{i}" for i, _ in cats)
    shares = ", ".join(f"CASE WHEN m > 0 THEN s{i} / ({total}) END AS r{i}" for i, _ in cats)
    kept = " + ".join(f"CASE WHEN r{i} > 0.1::DOUBLE THEN 1 ELSE 0 END" for i, _ in cats)
    return f"""
src AS ({source}),
padded AS (
  SELECT *, ' ' || regexp_replace(lower(text), '({_SEP})', '\\1\\1', 'g') || ' ' AS p FROM src
),
words AS (SELECT *, regexp_matches(p, '{_SEP}({negative}){_SEP}') AS neg, {counts} FROM padded),
hits AS (SELECT *, {hits} FROM words),
scores AS (SELECT *, {' + '.join(f'h{i}' for i, _ in cats)} AS m, {scores} FROM hits),
shares AS (SELECT *, {shares} FROM scores),
kept AS (SELECT *, {kept} AS n FROM shares),
v AS (
  SELECT *,
    CASE WHEN text IS NULL OR text = '' THEN 0 WHEN neg THEN 1 WHEN m = 0 THEN 2 ELSE 3 END AS k,
    k = 3 AS relevant,
    CASE k WHEN 0 THEN {EMPTY[0]} WHEN 1 THEN {VETOED[0]} WHEN 2 THEN {UNMATCHED[0]} ELSE
      printf('%.2f', (least(0.5::DOUBLE + n * 0.15::DOUBLE, 1) +
                      least(0.5::DOUBLE + m * 0.1::DOUBLE, 1)) / 2)::DOUBLE END::DOUBLE
      AS confidence,
    CASE k WHEN 0 THEN '{EMPTY[1]}' WHEN 1 THEN '{VETOED[1]}'
      WHEN 2 THEN '{UNMATCHED[1]}' ELSE
      CASE WHEN n > 1 THEN '{MANY_CATEGORIES}' ELSE '{ONE_CATEGORY}' END END AS reason,
    CASE WHEN k = 3 THEN concat_ws(',', {', '.join(
        f"CASE WHEN r{i} > 0.1::DOUBLE THEN '{c.name}' END" for i, c in cats)})
      ELSE '' END AS categories
  FROM kept
)"""


def category_sql(vocab: Vocabulary) -> str:
    """One row per article and significant category, from ``v``."""
    parts = []
    for i, c in enumerate(vocab.categories):
        matches = " || ".join(f"repeat('{w}|', w{i}_{j})" for j, w in enumerate(c.words))
        parts.append(
            f"SELECT doc_id, confidence, '{c.name}' AS name,"
            f" printf('%.2f', r{i})::DOUBLE AS score, h{i}::BIGINT AS hits,"
            f" rtrim({matches}, '|') AS matches FROM v WHERE k = 3 AND r{i} > 0.1::DOUBLE"
        )
    return " UNION ALL ".join(parts)


_NEWS = "WITH " + verdict_sql(ARTICLES, WEATHER)
_PROSE = "WITH " + verdict_sql("SELECT * FROM documents", PROSE)
_EVENTS = """WITH v AS (
  SELECT value / 500 AS confidence, event_type <> 'error' AS relevant FROM events
)"""


def _buckets(levels) -> str:
    rows = ", ".join(f"({t}::DOUBLE)" for t in levels)
    return f"""b AS (
  SELECT t.threshold, count(v.confidence)::BIGINT AS articles, avg(v.confidence) AS mean
  FROM (VALUES {rows}) t(threshold)
  LEFT JOIN v ON v.relevant AND v.confidence >= t.threshold GROUP BY 1
)"""


_DROPS = """d AS (
  SELECT threshold AS from_threshold,
         lead(threshold) OVER (ORDER BY threshold) AS threshold,
         articles - lead(articles) OVER (ORDER BY threshold) AS articles_dropped,
         CASE WHEN articles > 0
              THEN (articles - lead(articles) OVER (ORDER BY threshold)) * 100.0::DOUBLE / articles
              ELSE 0 END AS percentage_dropped,
         lead(articles) OVER (ORDER BY threshold) AS articles_left
  FROM b
)"""
_DROP_ROWS = """SELECT from_threshold, threshold, articles_dropped,
  round(percentage_dropped, 6) AS percentage_dropped, articles_left
  FROM d WHERE threshold IS NOT NULL"""


def _recommend(percent: float, articles: int) -> str:
    return f"""SELECT threshold, articles_dropped,
  round(percentage_dropped, 6) AS percentage_dropped, articles_left
  FROM d WHERE threshold IS NOT NULL
  ORDER BY NOT (percentage_dropped < {percent} AND articles_dropped < {articles}), threshold
  LIMIT 1"""


_BUCKET_ROWS = "SELECT threshold, articles, round(mean, 6) AS mean_confidence FROM b"
_NEWS_BUCKETS = f"{_NEWS}, {_buckets((0.5, 0.6, 0.7, 0.8, 0.9))}"
_EVENT_BUCKETS = f"{_EVENTS}, {_buckets(EVENT_LEVELS)}"
_VERDICT_ROWS = "SELECT doc_id, relevant, confidence, categories, reason FROM v"
_CATEGORY_ROWS = "SELECT doc_id, name, score, hits, matches FROM ({})"

ORACLE = {
    "relevance_verdict": f"{_NEWS} {_VERDICT_ROWS}",
    "relevance_categories": f"{_NEWS} {_CATEGORY_ROWS.format(category_sql(WEATHER))}",
    "prose_verdict": f"{_PROSE} {_VERDICT_ROWS}",
    "prose_categories": f"{_PROSE} {_CATEGORY_ROWS.format(category_sql(PROSE))}",
    "negative_context": f"{_PROSE} SELECT doc_id, confidence FROM v WHERE k = 1",
    "empty_guard": f"""{_NEWS} SELECT reason, count(*) AS articles,
        min(confidence) AS lowest, max(confidence) AS highest FROM v GROUP BY 1""",
    "relevance_gate": f"""{_NEWS} SELECT doc_id, confidence FROM v
        WHERE relevant AND confidence >= 0.7::DOUBLE""",
    "relevant_articles": f"{_NEWS} SELECT doc_id, url FROM v WHERE relevant",
    "is_relevant": f"{_PROSE} SELECT doc_id, relevant FROM v",
    "category_report": f"""{_PROSE} SELECT name, count(*) AS articles,
        sum(hits)::BIGINT AS hits, round(avg(score), 6) AS mean_share,
        round(avg(confidence), 6) AS mean_confidence
        FROM ({category_sql(PROSE)}) WHERE confidence >= 0.65::DOUBLE GROUP BY 1""",
    "run_summary": f"""{_NEWS}, c AS (
        SELECT count(*) AS total_articles,
               count(*) FILTER (relevant AND confidence >= 0.65::DOUBLE) AS relevant_articles FROM v)
        SELECT total_articles, relevant_articles,
          printf('%.2f', relevant_articles::DOUBLE / total_articles * 100)::DOUBLE AS relevance_rate,
          0.65::DOUBLE AS confidence_threshold FROM c""",
    "threshold_buckets": f"{_NEWS_BUCKETS} {_BUCKET_ROWS}",
    "threshold_categories": f"""{_NEWS_BUCKETS}
        SELECT b.threshold, c.name, count(*) AS count
        FROM b JOIN ({category_sql(WEATHER)}) c ON c.confidence >= b.threshold GROUP BY 1, 2""",
    "borderline_sample": f"""{_NEWS} SELECT url, confidence, categories FROM v
        WHERE relevant AND confidence BETWEEN 0.55::DOUBLE AND 0.65::DOUBLE
        ORDER BY date NULLS FIRST, url LIMIT 5""",
    "threshold_drop": f"{_NEWS_BUCKETS}, {_DROPS} {_DROP_ROWS}",
    "threshold_recommend": f"{_NEWS_BUCKETS}, {_DROPS} {_recommend(30, 50)}",
    "event_threshold_buckets": f"{_EVENT_BUCKETS} {_BUCKET_ROWS}",
    "event_threshold_drop": f"{_EVENT_BUCKETS}, {_DROPS} {_DROP_ROWS}",
    "event_threshold_recommend": f"{_EVENT_BUCKETS}, {_DROPS} {_recommend(50, 1_000_000_000)}",
}
