from __future__ import annotations

import csv
import datetime as dt
import json
import pathlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from galeledger import schemas, session
from galeledger.operators import order
from galeledger.plans import news, wind
from galeledger.sources import files
from galeledger.streaming.news import classify_new_files, stream_articles

ARTICLES = [
    {"date": "2023-08-07", "url": "x", "text": "Torm jättis Tartumaal 1200 klienti elektrita."},
    {"date": "2023-08-06", "url": "y", "text": "Rahe ja torm Võrumaal.\nKahju 2,5 miljonit eurot."},
    {"date": "2023-08-06", "url": "k", "text": "Kontsert, torm."},
    {"url": "z", "text": "Päästjad: tugev tuul Ruusmäel, oht."},
    {"date": "2023-08-01", "url": "t"},
    {"date": "2023-08-01", "url": "r", "text": "Rahe."},
]


@pytest.fixture
def corpus(tmp_path):
    path = tmp_path / "articles.json"
    path.write_text(json.dumps(ARTICLES, ensure_ascii=False), encoding="utf-8")
    return str(path)


def in_part_order(out):
    """``(date, url)`` of the results as they stand in the files, in name order."""
    found = []
    for part in sorted(pathlib.Path(out, "results").glob("part-*.json")):
        found += [json.loads(line) for line in part.read_text(encoding="utf-8").splitlines()]
    return [(r.get("date"), r["url"]) for r in found]


def test_results_are_in_date_order_over_many_parts(spark, tmp_path, monkeypatch):
    """Ties in date and url follow the input, also over several sorted parts."""
    day = lambda i: f"2023-01-{i % 3 + 1:02d}"
    rows = [{"date": day(i), "url": f"u{i % 2}", "text": f"Torm ja rahe {i}. {i} klienti"} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(rows), encoding="utf-8")
    monkeypatch.setattr(order.sort_by_date, "__defaults__", (1000,))
    out = str(tmp_path / "out")
    news.process_news(spark, str(tmp_path / "a.json"), out, 0.65)
    lines = []
    parts = sorted(pathlib.Path(out, "results").glob("part-*.json"))
    for part in parts:
        lines += [json.loads(line) for line in part.read_text(encoding="utf-8").splitlines()]
    assert sum(p.stat().st_size > 0 for p in parts) > 2
    number = lambda r: int(r["classification"]["severity"]["affected_customers"])
    found = [(r["date"], r["url"], number(r)) for r in lines]
    assert found == sorted((r["date"], r["url"], i) for i, r in enumerate(rows))


def test_news_job_reads_its_corpus_once(spark, corpus, tmp_path):
    """Counts and texts come from the judged table, so a vanished corpus changes nothing."""
    plans = []
    written = session.materialise

    def keep(df, label):
        plans.append(df.inputFiles())
        return written(df, label)

    import galeledger.plans.news as job

    original, job.materialise = job.materialise, keep
    try:
        news.process_news(spark, corpus, str(tmp_path / "o"), 0.65)
    finally:
        job.materialise = original
    assert sum(any("articles.json" in f for f in p) for p in plans) == 1


def test_news_job_and_its_reports(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    places = spark.createDataFrame([("Ruusmäel",)], "name string")
    news.process_news(spark, corpus, out, 0.65, place_names=places)
    results = files.read_results(spark, out)
    assert results.schema == schemas.CLASSIFIED
    assert sorted(r["url"] for r in results.collect()) == ["x", "y", "z"]
    assert in_part_order(out) == [(None, "z"), ("2023-08-06", "y"), ("2023-08-07", "x")]
    reports = news.analyze_results(spark, out)
    summary = reports["summary"].first()
    assert (summary["total_articles"], summary["relevant_articles"]) == (6, 3)
    assert (summary["relevance_rate"], summary["confidence_threshold"]) == (50.0, 0.65)
    assert summary["processing_date"].date() >= dt.date(2024, 1, 1)
    assert [tuple(r) for r in reports["locations"].collect()] == [
        ("Ruusmäel", 1), ("Tartumaa", 1), ("Võrumaa", 1),
    ]
    assert [tuple(r) for r in reports["damage_types"].collect()] == [
        ("storm", 2), ("power_outage", 1),
    ]


def test_ungated_job(spark, corpus):
    found = {r["url"]: r["classification"] for r in news.process_ungated(spark, corpus).collect()}
    assert set(found) == set("xykztr")
    assert found["y"]["severity"]["financial_damage"]["amount"] == 2_500_000
    assert found["t"]["severity"]["scale"] == "unknown"


def test_threshold_job(spark, corpus):
    reports = news.analyze_thresholds(files.read_articles(spark, corpus))
    assert [tuple(r)[:2] for r in reports["buckets"].orderBy("threshold").collect()] == [
        (0.5, 4), (0.6, 4), (0.7, 2), (0.8, 1), (0.9, 0),
    ]
    assert [r["url"] for r in reports["borderline"].collect()] == ["r"]
    assert reports["recommendation"].first()["threshold"] == 0.6
    assert reports["categories"].filter("threshold = 0.7").count() > 0


def test_corpus_job(spark, tmp_path):
    month = {"seriesList": {"contents": [
        {"date": "2023-01-02", "heading": "UUDISED. Torm", "lead": "Lead", "url": "u1", "id": 5},
        {"date": "2023-01-03", "heading": "Muu", "url": "u2"},
    ]}}
    (tmp_path / "months").mkdir()
    for i in (1, 2):
        (tmp_path / "months" / f"{i}.json").write_text(json.dumps(month))
        for record in month["seriesList"]["contents"]:
            record["url"] += "x"
    landed = [
        {"url": "u1", "response": [{"data": [{"content": "a"}, {"content": "b"}]}, {"data": []}]},
        {"url": "u2", "response": []},
        {"url": "u1x", "error": "timeout"},
    ]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, landed)))
    articles = news.build_corpus(
        spark, str(tmp_path / "months"), str(tmp_path / "pages.json"), str(tmp_path / "corpus")
    )
    day = dt.date(2023, 1, 2)
    assert sorted(tuple(r) for r in articles.collect()) == [
        (day, "u1", "Torm\nLead\na\nb"),
        (day, "u1x", "Torm\nLead"),
        (dt.date(2023, 1, 3), "u2", "Muu"),
        (dt.date(2023, 1, 3), "u2x", "Muu"),
    ]
    assert news.sample_corpus(articles, [2]).first()["url"] == "u1x"


STATIONS = """Narva
Laius: N 59°23’22”
Pikkus: E 28°06’33”
AJNARV01


 Kuressaare\x20
Laius: N 58°13’05”

Pikkus: E 22°30’23”
AJKURE_L
Tühi
AJTYHI01
Narva
Pikkus: E 28°06’34”
x Laius: N 1°1’1”
Vigane
Laius: põhjas
"""


def test_station_list(spark, tmp_path):
    (tmp_path / "stations.txt").write_text(STATIONS, encoding="utf-8")
    found = files.read_stations(spark, str(tmp_path / "stations.txt"))
    assert found.schema == schemas.STATION
    table = {r["station"]: r for r in found.collect()}
    assert set(table) == {"Narva", "Kuressaare", "Vigane"}
    assert table["Narva"]["latitude"] == "N 59°23’22”"
    assert table["Narva"]["longitude"] == "E 28°06’34”"
    assert table["Kuressaare"]["lon_deg"] == pytest.approx(22 + 30 / 60 + 23 / 3600)
    assert table["Vigane"]["lat_deg"] is None and table["Vigane"]["longitude"] is None


def test_wind_job(spark, tmp_path):
    (tmp_path / "stations.txt").write_text(STATIONS, encoding="utf-8")
    (tmp_path / "pages").mkdir()

    def row(station, month, value, **more):
        return {"jaam_nimi": station, "aasta": 2023, "kuu": month, "element_kood": "DWSX",
                "vaartus": value, "id": 1, **more}

    pages = [
        [row("Narva", 1, 4.0, paev=7), row("Mujal", 2, 6.0)],
        [row("Narva", 1, 8), row("Narva", 1, 99.0, aasta=2022), row("N", 1, 9.0, element_kood="T")],
    ]
    for i, page in enumerate(pages):
        (tmp_path / "pages" / f"{i}.json").write_text(json.dumps(page))
    out = str(tmp_path / "out")
    reports = wind.process_wind(
        spark, str(tmp_path / "pages"), str(tmp_path / "stations.txt"), out
    )
    assert tuple(reports["statistics"].first()) == (2, 3, 8.0, 4.0, 6.0)
    assert [tuple(r) for r in reports["months"].collect()] == [(1, 6.0), (2, 6.0)]
    by_name = {r["jaam_nimi"]: r for r in reports["stations"].collect()}
    assert by_name["Narva"]["latitude"] == "N 59°23’22”" and by_name["Mujal"]["latitude"] is None
    csv = files.read_csv(spark, f"{out}/csv", None)
    assert csv.count() == 3
    stored = files.read_csv(spark, f"{out}/csv", None)
    assert stored.columns.index("latitude") > 0 and {"id", "paev"} <= set(stored.columns)
    assert stored.filter("latitude IS NOT NULL AND id = '1'").count() == 2
    assert {r["paev"] for r in spark.read.json(f"{out}/json").collect()} == {7, None}


def test_csv_keeps_text_as_it_is(spark, tmp_path):
    rows = [("a,b", 'say "x"\nnext'), ("NA", None), ("ö\\", " s ")]
    df = spark.createDataFrame(rows, "a string, b string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema).collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


@pytest.fixture
def split_size(spark):
    """Sets the size of a split for one test."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, before)


def write_one_csv(path, rows):
    """One file as a spreadsheet would write it, with quotes only where they are needed."""
    with path.open("w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerows([("a", "b"), *rows])


def test_a_large_csv_file_is_split_unless_fields_have_line_breaks(spark, tmp_path, split_size):
    rnd = random.Random(3)
    make = lambda: "".join(rnd.choice('ab ,"öü') for _ in range(rnd.randint(1, 12))) + "."
    rows = [(str(i), make()) for i in range(3000)]
    write_one_csv(tmp_path / "plain.csv", rows)
    split_size("8192")
    plain = files.read_csv(spark, str(tmp_path / "plain.csv"), None)
    assert plain.rdd.getNumPartitions() > 3
    assert Counter(map(tuple, plain.collect())) == Counter(rows)
    whole = files.read_csv(spark, str(tmp_path / "plain.csv"), None, multiline=True)
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == 3000
    broken = [*rows, ("3000", "one\ntwo"), ("3001", '"\n,\n"')]
    write_one_csv(tmp_path / "broken.csv", broken)
    found = files.read_csv(spark, str(tmp_path / "broken.csv"), None)
    assert Counter(map(tuple, found.collect())) == Counter(broken)
    # Files that are one task anyway need no look at their lines.
    split_size("128MB")
    assert files.split_bytes(spark) == 128 << 20
    assert files.read_csv(spark, str(tmp_path / "broken.csv"), None).count() == 3002


def test_check_filter_splits_its_files(spark, tmp_path, split_size):
    write_one_csv(tmp_path / "archive.csv", [(f"u{i}", "x") for i in range(4000)])
    (tmp_path / "archive.csv").write_text((tmp_path / "archive.csv").read_text().replace("a,b\n", "url,b\n", 1))
    (tmp_path / "filtered.csv").write_text("url,b\nu7,x\nu9,y\n")
    split_size("4096")
    found = news.check_filter(spark, str(tmp_path / "archive.csv"), str(tmp_path / "filtered.csv"))
    assert [r["url"] for r in found["missed"].collect()] == ["u9"] and found["found"].count() == 2
    whole = news.check_filter(spark, str(tmp_path / "archive.csv"), str(tmp_path / "filtered.csv"), multiline=True)
    assert whole["found"].count() == 2


def test_lines_that_end_inside_a_field(spark):
    """Against reading the line character by character."""

    def open_line(line):
        at_start = quoted = False
        at_start, i = True, 0
        while i < len(line):
            c = line[i]
            if quoted:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    quoted = False
            elif at_start and c == '"':
                quoted, at_start = True, False
            else:
                at_start = c == ","
            i += 1
        return quoted

    rnd = random.Random(6)
    lines = ["".join(rnd.choice('a,"') for _ in range(rnd.randint(0, 9))) for _ in range(800)]
    lines += ['"' * 20_000, "a," * 20_000]
    found = spark.createDataFrame(list(enumerate(lines)), "i int, v string").select(
        "i", (~F.col("v").rlike(files._CLOSED_LINE)).alias("open")
    )
    assert {r["i"]: r["open"] for r in found.collect()} == {i: open_line(x) for i, x in enumerate(lines)}


def test_streamed_files_are_classified_once(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i, article in enumerate(ARTICLES):
        if i == 3:
            classify_new_files(stream_articles(spark, landing), out, state).awaitTermination(120)
            assert files.read_results(spark, out).count() == 3 - 1
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(article))
    classify_new_files(stream_articles(spark, landing), out, state).awaitTermination(120)
    assert sorted(r["url"] for r in files.read_results(spark, out).collect()) == list("rxyz")


def test_batch_and_streamed_results_are_read_together(spark, corpus, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    news.process_news(spark, corpus, out, 0.65)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"url": "w", "text": "Torm, rahe, äike."}))
    classify_new_files(stream_articles(spark, landing), out, state).awaitTermination(120)
    assert sorted(r["url"] for r in files.read_results(spark, out).collect()) == list("wxyz")


def test_archive_export_and_filter_check(spark, tmp_path):
    def month(*records):
        return {"seriesList": {"contents": list(records)}}

    (tmp_path / "m").mkdir()
    for i in range(2):
        records = [{"url": f"u{i}{k}", "date": "2023-01-01", "heading": "H, x", "media": {"n": k}} for k in range(3)]
        (tmp_path / "m" / f"{i}.json").write_text(json.dumps(month(*records)))
    news.export_archive(spark, str(tmp_path / "m"), str(tmp_path / "out"))
    csv = files.read_csv(spark, str(tmp_path / "out" / "csv"), None)
    assert csv.count() == 6 and csv.first()["media"].startswith('{"n"')
    assert spark.read.json(str(tmp_path / "out" / "json")).agg(F.sum("media.n")).first()[0] == 6
    (tmp_path / "filtered.csv").write_text("url,heading\nu00,\"H, x\"\nu01,other\nzz,\n")
    found = news.check_filter(spark, str(tmp_path / "out" / "csv"), str(tmp_path / "filtered.csv"))
    urls = {k: sorted(r["url"] for r in v.collect()) for k, v in found.items()}
    assert urls == {"found": ["u00", "u01"], "joined": ["u00", "u01", "zz"], "unlike": ["u01", "zz"], "missed": ["u01"]}


def test_sample_corpus_is_written(spark, corpus, tmp_path):
    news.write_sample(files.read_articles(spark, corpus), str(tmp_path / "sample"), [1, 3])
    assert spark.read.json(str(tmp_path / "sample")).count() == 2


def test_intermediate_tables_live_in_the_shared_folder(spark):
    kept = session.materialise(spark.range(5), "numbers")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(f.startswith(f"file://{folder}/numbers-") for f in kept.inputFiles())
    assert kept.agg(F.sum("id")).first()[0] == 10
