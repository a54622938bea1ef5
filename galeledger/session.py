"""Session defaults and fault-tolerant intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_TARGET_BYTES = 128 * 1024 * 1024


def build_session(
    app_name: str = "galeledger",
    master: str | None = None,
    input_bytes: int | None = None,
    **conf,
) -> SparkSession:
    """Session with the settings the operators are designed for.

    Adaptive execution splits hot join keys and merges small shuffle partitions,
    so the number of partitions may be chosen high: ``input_bytes``, the size of
    the largest table that is joined or sorted, sets it to one per 128 MB.
    ``conf`` entries (dots written as ``__``) override anything.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Splitting a hot key is worth an extra exchange after the join.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if input_bytes:
        settings["spark.sql.shuffle.partitions"] = max(200, input_bytes // SHUFFLE_TARGET_BYTES)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    That is ``spark.checkpoint.dir``. Only a session whose tasks all run in this
    process, without that setting, falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="galeledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a shared table and continue from it.

    Several reports, or a range sort (which samples its input first), then read
    finished columns instead of scanning every text again, also after executors
    are lost. The table stays in the shared folder until the cluster clears it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
