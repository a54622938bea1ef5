"""Filters of join keys, the index of rarest pieces, and what they leave to be shuffled."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from galeledger.operators import filters, places
from galeledger.operators.places import with_locations, with_other_names

SCHEMA = "ord int, name string, type string, confidence double, stem string"


def passing(spark, known, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").withColumn("ok", known(F.col("v")))
    return {r["v"] for r in rows.collect() if r["ok"]}


@pytest.mark.parametrize("n", [0, 1, 3, 500])
def test_a_filter_loses_no_key_and_little_else_passes(spark, n):
    keys = [f"k{i}" for i in range(n)]
    known = filters.key_filter(spark.createDataFrame([(k,) for k in keys], "k string"), "k")
    assert passing(spark, known, keys) == set(keys)
    assert len(passing(spark, known, [f"x{i}" for i in range(2000)])) < 100


def test_a_filter_too_small_for_its_keys_lets_everything_through(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    assert len(passing(spark, filters.key_filter(keys, "k", most=1024), [f"x{i}" for i in range(100)])) == 100
    assert filters.filter_bits(10**9) == filters.MOST_BITS and filters.filter_bits(4) == 4096


def test_the_rarest_piece_of_a_stem(spark):
    stems = [(i, s, "t", 0.5, s) for i, s in enumerate(["abcdx", "abcdy", "abcd", "zabcd", "ab", "ab", "õäöü"])]
    found = places.keyed_stems(spark.createDataFrame(stems, SCHEMA))
    pieces = {(r["place"]["ord"], r["place"]["stem"]): r["piece"] for r in found.collect()}
    # "abcd" is in four stems; "abcd" itself has nothing else.
    assert pieces == {
        (0, "abcdx"): "bcdx", (1, "abcdy"): "bcdy", (2, "abcd"): "abcd", (3, "zabcd"): "zabc",
        (4, "ab"): "ab", (5, "ab"): "ab", (6, "õäöü"): "õäöü",
    }


def make_texts(rnd, n, vocabulary):
    return [
        "".join(rnd.choice(vocabulary) + rnd.choice(["", " ", "-", ". "]) for _ in range(rnd.randint(0, 40)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_stems_of_all_lengths_equal_plain_containment(spark, texts, seed):
    rnd = random.Random(seed)
    vocabulary = ["ab", "ba", "abba", "õ", "Õü", "tartu", "TART", "x", "İ", "järv"]
    values = make_texts(rnd, 60, vocabulary) + [None, ""]
    values += [values[3]] * 30 + ["y" * 200]
    stems = [
        (rnd.choice([i, None]), f"n{i % 25}", rnd.choice(["a", None]), rnd.choice([0.5, None]),
         "".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 1, 2, 3, 60]))))
        for i in range(40)
    ]
    stems += [(50 + n, f"y{n}", "long", 1.0, "y" * n) for n in (1, 2, 3, 4, 5, 149, 150, 201)]
    table = spark.createDataFrame(stems, SCHEMA)
    small = with_locations(texts(values), table).orderBy("id").collect()
    assert with_locations(texts(values), table, small=0).orderBy("id").collect() == small
    assert [p["name"] for p in small[-1]["locations"]] == ["y1", "y2", "y3", "y4", "y5", "y149", "y150"]


@pytest.fixture
def shuffled_joins(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df):
    """Rows written by each shuffle of a query, from its metrics."""
    df.collect()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_rows_shuffled_dont_grow_with_the_lengths_of_stems(spark, shuffled_joins):
    """Twenty lengths of stems, one text of all different pieces: at most four rows a
    place in the text are cut, and only those of stems are shuffled."""
    rnd = random.Random(4)
    text = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(20_000))
    stems = spark.createDataFrame([(n, f"n{n}", "t", 1.0, text[50 * n : 51 * n]) for n in range(1, 21)], SCHEMA)
    articles = spark.createDataFrame([(1, text)], "id int, text string")
    cleaned = places.clean_stems(stems)
    assert max(written(places.stem_candidates(articles, cleaned))) < 400
    found = with_locations(articles, stems, small=0).first()["locations"]
    assert len(found) == 20


def test_rows_shuffled_for_names_are_those_found(spark, shuffled_joins):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    text = " ".join(rnd.choice(words) for _ in range(20_000)) + " w7 w8 w9"
    names = spark.createDataFrame([(f"w{i} w{i + 1}",) for i in range(50)] + [("q r s t u v w",)], "name string")
    articles = spark.createDataFrame([(1, text)], "id int, text string")
    listed = places.clean_names(names)
    assert max(written(places.name_hits(articles, places.materialise(listed, "names")))) <= 200
    small, large = (with_other_names(articles, names, small=n).first()["other_names"] for n in (1000, 0))
    assert small == large and {"w7 w8", "w8 w9"} <= set(large)


def test_a_hot_piece_is_split(spark, hot_plan):
    """A piece that half of all texts have is split among tasks."""
    hot = F.col("id") % 2 == 0
    articles = spark.range(0, 40_000, 1, 8).select(
        "id", F.concat(F.when(hot, F.lit("antsla ")).otherwise(F.lit("rõuge ")), F.col("id").cast("string")).alias("text")
    )
    stems = spark.createDataFrame([(0, "Antsla", "t", 1.0, "antsla"), (1, "Rõuge", "t", 1.0, "rõuge")], SCHEMA)
    found = with_locations(articles, stems, small=0)
    rows, plan = hot_plan(found.select("id", F.element_at("locations", 1)["name"].alias("n")))
    assert sum(r["n"] == "Antsla" for r in rows) == 20_000 == sum(r["n"] == "Rõuge" for r in rows)
    assert "skew=true" in plan


def test_filters_are_folded_literals(spark):
    known = filters.key_filter(spark.range(200_000).select(F.col("id").cast("string").alias("k")), "k")
    df = spark.createDataFrame([("7",)], "v string").select(known(F.col("v")).alias("ok"))
    assert df.first()["ok"] and "from_json" not in df._jdf.queryExecution().executedPlan().toString()
