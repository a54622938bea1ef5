"""Physical plans of all registered queries, as a cluster would run them."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from galeledger.functions.text import scan_groups
from galeledger.operators import joins, prepare
from galeledger.operators.places import with_other_names
from galeledger.vocab import WEATHER
from tests.test_queries import OWN, SF_DIR, pytestmark  # noqa: F401

# Windows over a row per threshold, the parts of an order or the lines of a small file.
SHORT_WINDOWS = {
    "stations_landed", "wind_outputs",
    "threshold_drop", "threshold_recommend", "event_threshold_drop",
    "event_threshold_recommend", "slice_rows", "slice_orders",
}


@pytest.fixture(scope="module")
def plan(spark):
    """Plan text of a query when no table is known to be small."""
    before = {
        "spark.sql.autoBroadcastJoinThreshold": spark.conf.get(
            "spark.sql.autoBroadcastJoinThreshold"
        ),
        "spark.sql.maxPlanStringLength": spark.conf.get("spark.sql.maxPlanStringLength"),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")

    def text(name):
        df = queries()[name](spark, SF_DIR)
        return df._jdf.queryExecution().executedPlan().toString()

    yield text
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("name", OWN)
def test_plan(plan, name):
    text = plan(name)
    for operator in ("CartesianProduct", "NestedLoop", "BroadcastExchange", "EvalPython"):
        assert operator not in text, operator
    assert "from_json" not in text  # nested literals are folded
    if name not in SHORT_WINDOWS:
        assert not re.search(r"^\W*Window ", text, re.M)


@pytest.mark.parametrize(
    "name",
    ["relevance_verdict", "relevance_gate", "run_summary", "threshold_categories", "empty_guard",
     "borderline_sample", "location_top10", "damage_distribution"],
)
def test_keywords_are_scanned_in_one_place(plan, name):
    assert plan(name).count("regexp_extract_all(") == len(scan_groups(WEATHER.all_words))


@pytest.mark.parametrize("name", ["location_top10", "location_mentions"])
def test_places_are_matched_in_one_place(plan, name):
    assert plan(name).count("Kirde-Eesti") == 1


@pytest.mark.parametrize("name", ["relevance_verdict", "gated_articles", "classify_articles"])
def test_classifying_needs_no_shuffle_of_its_own(plan, name):
    # The one exchange deals out the single row group of the small driver file.
    assert plan(name).count("Exchange") == 1


@pytest.mark.parametrize(
    "name, columns",
    [
        ("wind_global", {"o_orderkey", "o_custkey", "o_totalprice"}),
        ("monthly_mean", {"o_orderkey", "o_orderdate", "o_totalprice"}),
        ("event_threshold_drop", {"event_type", "value"}),
        ("prose_verdict", {"doc_id", "text"}),
    ],
)
def test_scans_read_only_what_is_used(plan, name, columns):
    (schema,) = re.findall(r"ReadSchema: struct<(.*?)>", plan(name))
    assert {c.split(":")[0] for c in schema.split(",")} == columns


@pytest.fixture
def hot_rows(spark):
    """Half of all rows are copies of one text with one url."""
    hot = F.col("id") % 2 == 0
    return spark.range(0, 40_000, 1, 8).select(
        "id",
        F.when(hot, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.when(hot, "Torm Antslas ja Antsla vald")
        .otherwise(F.concat(F.lit("Rõuge "), F.col("id").cast("string")))
        .alias("text"),
    )


def test_a_hot_text_is_split_when_it_is_joined(spark, hot_plan, hot_rows):
    names = spark.createDataFrame([("Antsla vald",), ("Rõuge",)], "name string")
    found = with_other_names(hot_rows, names, small=0)
    rows, plan = hot_plan(found.select("id", F.array_join("other_names", ",").alias("n")))
    assert Counter(r["n"] for r in rows) == {"Antsla vald": 20_000, "Rõuge": 20_000}
    assert plan.count("skew=true") == 2


@pytest.mark.parametrize("side", ["left", "right"])
def test_a_hot_url_is_split_on_either_side_of_a_left_join(hot_plan, hot_rows, side):
    single = hot_rows.select("url").distinct().withColumn("n", F.lit(1))
    few = single.unionByName(single.select(F.concat(F.lit("no"), "url").alias("url"), "n"))
    left, right = (hot_rows, single) if side == "left" else (few, hot_rows)
    rows, plan = hot_plan(joins.left_by_url(left, right))
    assert len(rows) == (40_000 if side == "left" else 40_000 + 20_001)
    assert "skew=true" in plan


def test_transcripts_are_shuffled_once(plan, spark):
    text = plan("transcript_attach")
    moved = [line for line in text.splitlines() if "transcript" in line and "Exchange hashpartitioning" in line]
    whole = re.findall(r"Exchange hashpartitioning\(url[^,]*, __rank", text)
    assert len(whole) == 2 and not moved


@pytest.mark.parametrize("kind", ["semi", "anti", "transcripts"])
def test_a_hot_url_is_split_when_it_is_joined(hot_plan, hot_rows, kind):
    other = hot_rows.filter("id % 4 < 2").select("url", F.col("text").alias("transcript"))
    joined = {
        "semi": lambda: joins.semi_by_url(hot_rows, other),
        "anti": lambda: joins.anti_natural(hot_rows, other.select("url")),
        "transcripts": lambda: prepare.attach_transcripts(hot_rows, other),
    }[kind]()
    rows, plan = hot_plan(joined)
    assert len(rows) == {"semi": 30_000, "anti": 10_000, "transcripts": 40_000}[kind]
    # The chosen row of a url is looked up before its text is.
    assert plan.count("skew=true") == (2 if kind == "transcripts" else 1)
