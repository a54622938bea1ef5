"""Inputs of the registered queries, derived row by row from the driver tables.

The driver's texts are invented prose without weather or numbers, so each whole
document gets a bulletin line appended whose wording depends on ``doc_id`` and
whose numbers come from ``n_chars``. The SQL below is read by both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BULLETINS = [
    "''",
    "'Torm jättis ' || CAST(n_chars AS STRING) || ' klienti elektrita.'",
    "'Tugev tuul ja torm: umbes ' || CAST(n_chars % 97 AS STRING)"
    " || ' 000 klienti Harjumaal. Päästjad said 14 väljakutset.'",
    "'Kontsert jäi ära, torm kestis ' || CAST(n_chars % 60 AS STRING) || ' tundi Saaremaal.'",
    "'Kahjustused ulatuvad ' || CAST(n_chars % 9 + 1 AS STRING)"
    " || ',5 miljoni euroni. Elektrikatkestus kestab veel '"
    " || CAST(n_chars % 90 AS STRING) || ' tundi.'",
    "'Infrastruktuuri kahjustused: katkenud liinid, murdunud puud, teed suletud."
    " Lõuna-Eestis ja Kagu-Eestis on ' || CAST(n_chars * 3 AS STRING)"
    " || ' majapidamist vooluta.'",
    "'Hoiatus! Ohtlik jäide ja kriis. ' || repeat('oht ', CAST(n_chars % 13 AS INT))",
    "'Elektrilevi: TORM, LUMETORM ja ÜLEUJUTUS Pärnus; ÄIKE Tartumaal."
    " 000 klienti, kokku 1,200 tarbijat.'",
    "'Ilmateade: homme torm Järvamaal, ' || CAST(n_chars AS STRING) || ' minutit.'",
    "'Kahju oli ' || CAST(n_chars * 50 AS STRING) || ' eurot, remont võtab '"
    " || CAST(n_chars % 70 AS STRING) || ' päeva.'",
    "'Rahe ja paduvihm Võrumaal ning Lääne-Virumaal. Häiritud liiklus, takistatud teed. '"
    " || CAST(n_chars AS STRING) || ' tarbijat.'",
    "'Kahju ligi ' || CAST(n_chars % 800 AS STRING) || ' tuhat eurot. Päästeamet ja"
    " häirekeskus: ' || CAST(n_chars % 120 AS STRING) || ' minutit.'",
    "'Päästjad: ' || repeat('oht ', 12) || 'Viljandis.'",
    "'Augustitorm, tormikahjustused, liinirikked ja rikked. Raske lumi, elektriliinid maas.'",
    "'üleujutus,üleujutatud tulvavesi. tugev vihm tugev vihm,tugev lumesadu '"
    " || CAST(n_chars % 7 AS STRING) || '00 050 klienti Põhja-Eestis 1.5 miljonit ja 500 tuhat €'",
    "repeat('torm elektrita päästjad kriis ', CAST(n_chars % 5 + 1 AS INT))"
    " || 'Ida-Virumaal ja Jõgeval, Valga ja Rapla.'",
    "'Õhtul sadas rahe. Teateid tuli ' || CAST(n_chars AS STRING) || '.'",
    "'Torm! Katkestus kestis ' || CAST(n_chars AS STRING)"
    " || '12345678901234567890 tundi, ' || CAST(n_chars AS STRING)"
    " || '98765432109876543210987 klienti.'",
]

_BULLETIN = "CASE doc_id % {n} {whens} END".format(
    n=len(BULLETINS), whens=" ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(BULLETINS))
)

ARTICLES = f"""
SELECT doc_id,
       DATE '2023-01-01' + CAST(doc_id % 365 AS INT) AS date,
       'uudised-' || source || '-' || CAST(doc_id AS STRING) AS url,
       text || chr(10) || {_BULLETIN} AS text
FROM documents
UNION ALL
SELECT item_id + 1000000000000 AS doc_id,
       CAST(NULL AS DATE) AS date,
       'tekstita-' || CAST(item_id AS STRING) AS url,
       CASE WHEN item_id % 2 = 0 THEN '' END AS text
FROM benchmark
"""

MEASUREMENTS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 40 > 0
            THEN 'Supplier#' || lpad(CAST(o_custkey % 150 AS STRING), 9, '0') END AS jaam_nimi,
       CAST(year(o_orderdate) AS INT) AS aasta,
       CAST(month(o_orderdate) AS INT) AS kuu,
       CASE WHEN o_orderstatus = 'P' THEN 'TA' ELSE 'DWSX' END AS element_kood,
       CASE WHEN o_orderkey % 31 > 0 THEN o_totalprice / 10000 END AS vaartus
FROM orders
"""

STATIONS = """
SELECT s_suppkey, s_name AS station,
       CASE WHEN s_suppkey % 5 = 0 THEN 'S ' ELSE 'N ' END
         || CAST(s_suppkey % 89 + 1 AS STRING) || '°' || CAST(s_suppkey % 60 AS STRING)
         || CASE WHEN s_suppkey % 2 = 0 THEN '’' ELSE '''' END
         || CAST(s_suppkey * 7 % 60 AS STRING)
         || CASE WHEN s_suppkey % 2 = 0 THEN '”' ELSE '"' END AS latitude,
       CASE WHEN s_suppkey % 7 = 0 THEN 'W ' ELSE 'E ' END
         || lpad(CAST(s_nationkey + 1 AS STRING), 2, '0') || '°'
         || lpad(CAST(s_suppkey * 3 % 60 AS STRING), 2, '0') || '’'
         || lpad(CAST(s_suppkey * 11 % 60 AS STRING), 2, '0') || '”' AS longitude
FROM supplier
"""

# Archive records and transcripts: a page per record, its transcript in pieces.
# Every eighth transcript belongs to no record.
CONTENTS = """
SELECT CAST(DATE '2023-01-01' + CAST(page_id % 365 AS INT) AS STRING) AS date,
       CASE WHEN page_id % 3 > 0 THEN 'UUDISED. ' ELSE '' END || 'Leht UUDISED. '
         || CAST(page_id AS STRING) AS heading,
       CASE WHEN page_id % 10 > 0 THEN 'Sisu ' || CAST(length(html) AS STRING) END AS lead,
       url, page_id AS id
FROM pages
"""

# Landed transcripts: the first landing, for some pages a second one, for some a third
# that failed.
SEGMENTS = """
SELECT page_id, CASE WHEN page_id % 8 > 0 THEN url ELSE url || '-puudub' END AS url, html, 1 AS landed
FROM pages
UNION ALL
SELECT page_id, url, 'Parandatud<' || html AS html, 2 AS landed
FROM pages WHERE page_id % 5 = 0
UNION ALL
SELECT page_id, url, CAST(NULL AS STRING) AS html, 3 AS landed
FROM pages WHERE page_id % 4 = 0
"""

# Each document with the name of one nation, or none.
TEXTS_OF_NATIONS = """
SELECT d.doc_id, d.text || coalesce(chr(10) || n.n_name, '') AS text
FROM documents d LEFT JOIN nation n ON d.doc_id % 30 = n.n_nationkey
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run input SQL over the driver tables it names."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)}
    for name in used:
        sql = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **used)


def on_all_cores(df: DataFrame) -> DataFrame:
    """The driver's tables have one row group, which is one task; deal the rows out."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_all_cores(derive(spark, sf_dir, ARTICLES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_all_cores(table(spark, sf_dir, "documents"))
