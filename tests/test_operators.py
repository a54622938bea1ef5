from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from galeledger.functions.events import locations
from galeledger.operators import joins, order, prepare, reports
from galeledger.operators.classify import classify_articles, gated_articles
from galeledger.operators.order import rows_at, sort_by_date
from galeledger.operators.places import with_locations, with_other_names
from galeledger.operators.relevance import with_verdict
from galeledger.operators.union import bind_rows, concat_pages
from galeledger.operators.wind import (
    enrich_with_stations,
    monthly_mean,
    station_summary,
    wind_statistics,
)

DAY = dt.date(2023, 5, 1)
ARTICLES = [
    (DAY, "b", "Torm ja rahe Tartus, 500 klienti elektrita."),
    (DAY, "a", "Torm ja rahe Tartus, 500 klienti elektrita."),
    (None, "c", "Päästjad: lumetorm Võrumaal ja Tartumaal, oht."),
    (DAY - dt.timedelta(1), "d", "Kontsert jäi tormi tõttu ära. Torm."),
    (DAY, "e", "Rahe."),
    (DAY, "f", None),
    (DAY, "g", "Ilus ilm Pärnus, torm, torm, elektrita, kriis, päästeamet ja üleujutus."),
]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES, "date date, url string, text string")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- corpus ---------------------------------------------------------------------


def test_corpus_has_one_row_per_record(spark):
    contents = spark.createDataFrame(
        [
            ("2023-01-02", "UUDISED. Torm", "Lead", "u1"),
            ("2023-01-02T10:00:00", "UUDISED: \tUUDISED. x", None, "u2"),
            ("unknown", None, "Lead", "u3"),
            ("2023-01-02", "UUDISED.", "Lead", "u1"),
        ],
        "date string, heading string, lead string, url string",
    )
    transcripts = spark.createDataFrame(
        [("u1", "text 3", 1), ("u1", "text 2", 2), ("u1", None, 3), ("u9", "z", 1), ("u2", None, 1), ("u1", "text 2", 2)],
        "url string, transcript string, landed int",
    )
    found = prepare.corpus(contents, transcripts).orderBy("url", "text")
    day = dt.date(2023, 1, 2)
    assert rows(found) == [
        (day, "u1", "Torm\nLead\ntext 2"),
        (day, "u1", "UUDISED.\nLead\ntext 2"),
        (day, "u2", "UUDISED. x"),
        (None, "u3", "Lead"),
    ]


def test_keyword_prefilter(texts):
    values = ["Augustitorm", "ÜLEUJUTUS", "elektrikatkestusi", "grahers", "ilus", "", None, "to\nrm"]
    kept = prepare.keyword_prefilter(texts(values)).orderBy("id")
    assert [r["text"] for r in kept.collect()] == values[:4]
    assert kept.columns == ["id", "text"]


def test_rows_at_positions(spark):
    numbers = spark.range(1000).select((F.col("id") * 37 % 1000).alias("n"))
    assert rows(rows_at(numbers, [3, 86, 1], "n")) == [(0,), (2,), (85,)]
    assert rows(rows_at(numbers.limit(2), [5], "n")) == []


def test_rows_at_positions_among_ties_copies_and_missing_keys(spark):
    values = [(None, "x"), (2, "b"), (2, "a"), (1, "z"), (2, "a"), (None, None), (2, "a")] + [(3, f"t{i}") for i in range(40)]
    table = spark.createDataFrame(values, "k int, text string").repartition(4)
    some = Counter()
    for p in (3, 4, 5, 6, 7, 48):
        some.update(rows(rows_at(table, [p], "k")))
    assert some == Counter(values[1:5] + values[6:7])
    # All at once: the same rows, copies as often as they occur.
    assert Counter(rows(rows_at(table, range(1, 60), "k"))) == Counter(values)
    assert sorted(rows(rows_at(table, [7, 4, 3, 3], "k", "text"))) == [(1, "z"), (2, "a"), (2, "b")]
    assert rows(rows_at(table, [], "k")) == rows(rows_at(table.limit(0), [1], "k")) == []


def test_rows_at_moves_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).select((F.col("id") * 7 % 5000).alias("n"), F.repeat(F.lit("x"), 50).alias("text")).write.parquet(path)
    found = rows_at(spark.read.parquet(path), [10, 4000], "n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "TakeOrderedAndProject" in plan
    assert "EqualNullSafe(n," in plan
    assert [r["n"] for r in found.collect()] == [9, 3999]


def test_rows_at_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(order, "PART_KEYS", 100)
    numbers = spark.range(3000).select((F.col("id") * 37 % 1000).alias("n"), "id")
    found = rows(rows_at(numbers, [1, 2, 3, 4, 1500, 2999, 3000, 3001], "n"))
    assert [r[0] for r in found] == [0, 0, 0, 1, 499, 999, 999]
    assert len(set(found)) == 7


# --- joins ----------------------------------------------------------------------


def test_joins_by_url(spark):
    left = spark.createDataFrame(
        [(1, "a"), (1, None), (2, "b"), (None, None)], "url int, status string"
    )
    right = spark.createDataFrame(
        [("a", 1, 10), ("a", 1, 11), (None, None, 12), ("x", 2, 13)],
        "status string, url int, n int",
    )
    assert rows(joins.semi_by_url(left, right).orderBy("url", "status")) == [
        (1, None), (1, "a"), (2, "b"),
    ]
    assert sorted(rows(joins.anti_natural(left, right)), key=str) == [(1, None), (2, "b")]
    assert joins.left_by_url(left, right.select("url", "n")).count() == 6
    assert rows(joins.rows_with_url_in(left, right.filter("n > 12"), "status")) == [("b",)]
    with pytest.raises(ValueError):
        joins.anti_natural(left.select("url"), right.select("n"))


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2.5)], "s string, d double")
    assert rows(bind_rows([a, b])) == [(1, "x", None), (None, "y", 2.5)]
    assert rows(concat_pages([a, a.select("s", "n")])) == [(1, "x"), (1, "x")]


# --- reports --------------------------------------------------------------------


def test_gated_is_part_of_ungated(articles):
    everything = {r["url"]: r["classification"] for r in classify_articles(articles).collect()}
    gated = {r["url"]: r["classification"] for r in gated_articles(articles, 0.65).collect()}
    assert set(everything) == set("abcdefg") and set(gated) == set("abcg")
    assert all(everything[url] == c for url, c in gated.items())


def test_sorted_by_date_with_missing_dates_first(articles):
    found = sort_by_date(gated_articles(articles, 0.65))
    assert [r["url"] for r in found.collect()] == ["c", "a", "b", "g"]
    assert found.columns == ["date", "url", "relevance", "classification"]


def test_summary(articles):
    judged = with_verdict(articles)
    assert rows(reports.run_summary(judged, 0.65)) == [(7, 4, 57.14, 0.65)]
    assert rows(reports.run_summary(judged)) == [(7, 5, 71.43, 0.6)]
    assert rows(reports.run_summary(judged.limit(0))) == [(0, 0, None, 0.6)]
    stored = reports.stored_summary(articles, gated_articles(articles, 0.65), 0.65).first()
    assert tuple(stored)[:3] == (7, 4, 57.14)


def test_frequencies(articles):
    gated = gated_articles(articles, 0.65)
    assert rows(reports.location_frequency(gated)) == [
        ("Tartumaa", 3), ("Pärnumaa", 1), ("Võrumaa", 1),
    ]
    assert rows(reports.location_frequency(gated, 1)) == [("Tartumaa", 3)]
    assert rows(reports.damage_distribution(gated)) == [
        ("storm", 4), ("power_outage", 3), ("flooding", 1), ("snow_storm", 1),
    ]


def test_thresholds(spark):
    scores = [0.62, 0.62, 0.7, 0.8, 0.8, 0.8, 0.97, 0.5]
    df = spark.createDataFrame([(s, True) for s in scores] + [(0.9, False)], "c double, r boolean")
    buckets = reports.threshold_buckets(df, confidence="c", relevant="r").cache()
    found = {r["threshold"]: (r["articles"], r["mean_confidence"]) for r in buckets.collect()}
    for t, (n, mean) in found.items():
        kept = [s for s in scores if s >= t]
        assert n == len(kept) and mean == pytest.approx(sum(kept) / len(kept))
    drops = reports.threshold_drops(buckets)
    assert [tuple(r)[:3] for r in drops.collect()] == [
        (0.5, 0.6, 1), (0.6, 0.7, 2), (0.7, 0.8, 1), (0.8, 0.9, 3),
    ]
    assert reports.recommend_threshold(drops).first()["threshold"] == 0.6
    assert reports.recommend_threshold(drops, 22, 2).first()["threshold"] == 0.6
    assert reports.recommend_threshold(drops, 50, 1).first()["threshold"] == 0.6
    assert reports.recommend_threshold(drops.filter("threshold > 0.6"), 25, 2).first()[
        "threshold"
    ] == 0.8


def test_empty_thresholds_are_reported(spark):
    none = spark.createDataFrame([], "c double, r boolean")
    buckets = reports.threshold_buckets(none, confidence="c", relevant="r")
    assert rows(buckets) == [(t, 0, None) for t in (0.5, 0.6, 0.7, 0.8, 0.9)]
    assert rows(reports.recommend_threshold(reports.threshold_drops(buckets))) == [
        (0.6, 0, 0.0, 0)
    ]


def test_threshold_categories_and_borderline(articles):
    judged = with_verdict(articles).cache()
    found = rows(reports.threshold_categories(judged))
    expected = Counter()
    for r in judged.filter("relevance.relevant").collect():
        for t in (0.5, 0.6, 0.7, 0.8, 0.9):
            for c in r["relevance"]["categories"]:
                expected[(t, c["name"])] += r["relevance"]["confidence"] >= t
    assert {(t, n): c for t, n, c in found} == {k: v for k, v in expected.items() if v}
    assert rows(reports.borderline_sample(judged)) == [("e", 0.62, ["severe_weather"])]


# --- transcripts ------------------------------------------------------------------


def test_a_transcript_is_found_whatever_order_its_source_has(spark):
    """Equal landings and ties, from a source that comes in another order each time it is
    read: every record has one transcript, always the same one."""
    landings = [(f"u{i % 50}", f"text {i % 7}" if i % 11 else None, i % 3) for i in range(600)]
    landings += [("u1", "text 1", 2)] * 40 + [(None, "no url", 9), ("u50", None, 9)]
    source = spark.createDataFrame(landings, "url string, transcript string, landed int")
    contents = spark.createDataFrame([(f"u{i % 52}", i) for i in range(104)] + [(None, 1)], "url string, n int")
    seen = set()
    for order in (F.rand(), F.rand(), F.col("transcript"), F.desc("landed")):
        found = prepare.attach_transcripts(contents, source.orderBy(order).repartition(5))
        seen.add(tuple(sorted(map(tuple, found.select("n", "url", "transcript").collect()), key=str)))
    (found,) = seen
    assert len(found) == 105
    latest = {}
    for url, text, landed in landings:
        if url and text and landed >= latest.get(url, (-1, set()))[0]:
            same = latest[url][1] if url in latest and latest[url][0] == landed else set()
            latest[url] = (landed, same | {text})
    for _, url, text in found:
        assert text in latest[url][1] if url in latest else text is None


# --- gazetteer tables -------------------------------------------------------------

STEMS = [
    (0, "Põhi", "region", 0.9, "põhja"),
    (1, "Tartu", "county", 1.0, "tartu"),
    (2, "Tartu", "city", 0.8, "Tart"),
    (3, "Järv", "lake", 0.5, "järv"),
    (4, "Oja", "river", 0.5, "o"),
]
TEXTS = ["Põhjajärve TARTUST", "tart", "", None, "oo järvo", "xyz", "Põhjajärve TARTUST", "x" * 200]


def test_large_and_small_gazetteers_agree(spark, texts):
    table = spark.createDataFrame(
        STEMS, "ord int, name string, type string, confidence double, stem string"
    )
    small = with_locations(texts(TEXTS), table).orderBy("id").collect()
    large = with_locations(texts(TEXTS), table, small=0).orderBy("id").collect()
    assert small == large
    assert [p["name"] for p in small[0]["locations"]] == ["Põhi", "Tartu", "Järv"]
    assert small[1]["locations"][0]["type"] == "city"
    assert small[3]["locations"] == []


def test_large_and_small_name_tables_agree(spark, texts):
    names = spark.createDataFrame(
        [("Antsla",), ("Antsla vald",), ("Aga",), ("Lääne-Nigula",), ("Rõuge",), ("Antsla",)],
        "name string",
    )
    values = [
        "Rõuge ja Antsla vald, Aga Rõuge", "Lääne-Nigula", "antsla", "", None, "Antsla Antsla",
        "Rõuge ja Antsla vald, Aga Rõuge",
    ]
    small = with_other_names(texts(values), names).orderBy("id").collect()
    large = with_other_names(texts(values), names, small=0).orderBy("id").collect()
    assert small == large
    assert small[0]["other_names"] == ["Rõuge", "Antsla", "Antsla vald"]
    assert small[2]["other_names"] == []
    found = with_other_names(texts(values), names).select(
        "id", locations(F.col("text"), (), F.col("other_names")).alias("l")
    )
    assert len(found.orderBy("id").first()["l"]) == 3


def test_stems_without_a_match_and_null_rows(spark, texts):
    """One answer for every table size: empty and null stems and names match nothing."""
    rows = STEMS + [
        (5, "Tühi", "x", 0.1, ""), (6, "Null", "x", 0.1, None), (7, None, "x", 0.1, "tartu"),
        (None, "Viimane", None, None, "xyz"), (8, "Pikk", "x", 0.1, "x" * 150),
    ]
    table = spark.createDataFrame(rows, "ord int, name string, type string, confidence double, stem string")
    for chosen in (table, table.limit(0)):
        small = with_locations(texts(TEXTS), chosen).orderBy("id").collect()
        large = with_locations(texts(TEXTS), chosen, small=0).orderBy("id").collect()
        assert small == large
    found = {p["name"] for r in with_locations(texts(TEXTS), table).collect() for p in r["locations"]}
    assert {"Viimane", "Pikk"} <= found and not found & {"Tühi", "Null", None}


def test_names_of_any_length_and_punctuation(spark, texts):
    names = spark.createDataFrame(
        [("Suure Jaani vana linnus",), ("St. Petersburg",), ("Kohtla  Järve",), ("O'Leary",), (None,), ("",),
         ("--",), ("aga",), ("Üks kaks kolm neli viis kuus seitse",), ("Petersburg",)],
        "name string",
    )
    values = [
        "Suure Jaani vana linnus ja St Petersburg, St. Petersburg", "Kohtla Järve; O’Leary", "aga --", None, "",
        "üks Üks kaks kolm neli viis kuus seitse kaheksa",
    ]
    small = with_other_names(texts(values), names).orderBy("id").collect()
    large = with_other_names(texts(values), names, small=0).orderBy("id").collect()
    assert small == large
    assert [r["other_names"] for r in small] == [
        ["Suure Jaani vana linnus", "St. Petersburg", "Petersburg"], ["Kohtla  Järve", "O'Leary"], [], [], [],
        ["Üks kaks kolm neli viis kuus seitse"],
    ]
    none = with_other_names(texts(values), names.limit(0), small=-1)
    assert all(r["other_names"] == [] for r in none.collect())


def test_joins_survive_a_hot_text(spark):
    """A third of all rows are copies of one text; every copy gets its places."""
    copies = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("Torm Antslas ja Tartus, Antsla vald"))
        .otherwise(F.concat(F.lit("Rõuge "), F.col("id").cast("string")))
        .alias("text"),
    )
    names = spark.createDataFrame([("Antsla vald",), ("Rõuge",)], "name string")
    found = with_other_names(copies, names, small=0)
    counts = found.groupBy(F.array_join("other_names", ",").alias("n")).count()
    assert dict(rows(counts)) == {"Antsla vald": 1000, "Rõuge": 2000}


# --- wind -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def measurements(spark):
    return spark.createDataFrame(
        [("Narva", 1, 4.0), ("Narva", 2, None), ("Narva", 2, 8.0), ("Ruhnu", 1, 6.0),
         ("Mujal", 1, 1.0), (None, 2, 30.0), ("Ruhnu", None, 2.0)],
        "jaam_nimi string, kuu int, vaartus double",
    )


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame(
        [("Narva", "N 59°10’20”", "E 28°30’40”"), ("Ruhnu", "N 57°05’00”", "E 23°50’10”")],
        "station string, latitude string, longitude string",
    )


def test_wind(measurements, stations):
    enriched = enrich_with_stations(measurements, stations)
    assert enriched.count() == 7
    assert enriched.filter("latitude IS NULL").count() == 2
    assert rows(wind_statistics(measurements)) == [(4, 7, 30.0, 1.0, 8.5)]
    assert rows(wind_statistics(measurements.filter("jaam_nimi = 'Narva'")))[0][:2] == (1, 3)
    summary = station_summary(measurements, stations).orderBy("jaam_nimi")
    assert [tuple(r)[:4] for r in summary.collect()] == [
        ("Mujal", 1.0, 1.0, 1), ("Narva", 6.0, 8.0, 2), ("Ruhnu", 4.0, 6.0, 2),
    ]
    assert summary.first()["latitude"] is None
    assert rows(monthly_mean(measurements)) == [(1, pytest.approx(11 / 3)), (2, 19.0)]
