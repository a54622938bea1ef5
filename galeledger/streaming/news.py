"""The gated corpus job on files as they land.

Judging and extraction are per-row expressions without state, so the batch
operator runs unchanged on a file stream. Each run picks up the files that are
new since the last one and stops; the checkpoint makes a run that lost its
driver or executors continue where it was, without losing or repeating articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from galeledger import schemas
from galeledger.operators.classify import gated_articles
from galeledger.vocab import DEFAULT_MIN_CONFIDENCE


def stream_articles(
    spark: SparkSession, folder: str, multiline: bool = False, files_per_batch: int = 1000
) -> DataFrame:
    """Articles of the JSON files in a folder, new files included as they land."""
    return (
        spark.readStream.schema(schemas.ARTICLE)
        .option("multiLine", multiline)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def classify_new_files(
    articles: DataFrame,
    output_path: str,
    checkpoint: str,
    min_confidence: float = DEFAULT_MIN_CONFIDENCE,
) -> StreamingQuery:
    """Add the classified relevant articles of all new files to the results of the batch
    job, which reports read.

    Every batch has a folder of its own below ``output_path/results``, so a batch that
    is run again replaces itself, and the other results stay readable as they are.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{output_path}/results/streamed-{number:010d}")

    return (
        gated_articles(articles, min_confidence)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
