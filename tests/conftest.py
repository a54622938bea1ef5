from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from galeledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """DataFrame ``(id, text)`` of the given texts."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "id int, text string")

    return make


@pytest.fixture(scope="session")
def evaluate(texts):
    """Values of a column function on the given texts, in order."""

    def run(values, function):
        from pyspark.sql import functions as F

        rows = texts(values).select("id", function(F.col("text")).alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["id"])]

    return run


@pytest.fixture
def hot_plan(spark):
    """Plan after running a query with no table known to be small and thresholds
    low enough for the test data to count as skewed."""
    settings = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)

    def run(df):
        rows = df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        return rows, text[: text.index("Initial Plan")]

    yield run
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
