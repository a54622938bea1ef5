"""Wind queries on orders as measurements and suppliers as stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeledger import schemas
from galeledger.functions.geo import dms_to_degrees
from galeledger.operators.union import concat_pages
from galeledger.operators.wind import (
    enrich_with_stations,
    monthly_mean,
    station_summary,
    wind_statistics,
)
from galeledger.plans.wind import process_wind
from galeledger.session import scratch_path
from galeledger.sources.files import (
    read_csv,
    read_measurements,
    read_stations,
    write_csv,
    write_json,
)
from workload.inputs import MEASUREMENTS, STATIONS, derive

# --- Spark ------------------------------------------------------------------


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, MEASUREMENTS)


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, STATIONS).select("station", "latitude", "longitude")


def station_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stations(spark, sf_dir).select(
        "station",
        F.round(dms_to_degrees(F.col("latitude")), 9).alias("lat_deg"),
        F.round(dms_to_degrees(F.col("longitude")), 9).alias("lon_deg"),
    )


def station_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_with_stations(
        _measurements(spark, sf_dir), _stations(spark, sf_dir)
    ).select("o_orderkey", "jaam_nimi", "vaartus", "latitude", "longitude")


def _pages(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The first and second half of every year, and the first once more."""
    rows = _measurements(spark, sf_dir).select(*schemas.MEASUREMENT.fieldNames())
    first, second = rows.filter("kuu <= 6"), rows.filter("kuu > 6")
    return [first, second, first]


def page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed as JSON files, the first one twice, read back as one table."""
    folder = scratch_path(spark, "pages")
    for i, page in enumerate(_pages(spark, sf_dir)):
        write_json(page, f"{folder}/page={i}")
    rows = read_measurements(
        spark, [f"{folder}/page={i}" for i in range(3)], 1997, "DWSX", fmt="jsonl"
    )
    return rows.groupBy("jaam_nimi", "kuu").agg(
        F.count("*").alias("measurements"), F.round(F.max("vaartus"), 6).alias("max_speed")
    )


def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = concat_pages(_pages(spark, sf_dir))
    return pages.groupBy("aasta", "kuu").agg(F.count("*").alias("measurements"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = enrich_with_stations(_measurements(spark, sf_dir), _stations(spark, sf_dir))
    folder = scratch_path(spark, "measurements-csv")
    write_csv(enriched, folder)
    back = read_csv(spark, folder, enriched.schema, multiline=False)
    return back.select("o_orderkey", "jaam_nimi", "kuu", "vaartus", "latitude", "longitude")


def stations_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as blocks of the station list, written as text and read back."""
    folder = scratch_path(spark, "stations")
    lines = F.concat_ws(
        "\n", F.concat(F.lit(" "), "station"), F.concat(F.lit("Laius: "), "latitude"), F.lit(""),
        F.concat(F.lit("Pikkus: "), "longitude"), F.lit("AJTEST01"),
    )
    _stations(spark, sf_dir).select(lines).write.text(folder)
    return read_stations(spark, folder).select(
        "station", "latitude", "longitude",
        F.round("lat_deg", 9).alias("lat_deg"), F.round("lon_deg", 9).alias("lon_deg"),
    )


def wind_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wind job on pages with a field that it does not know, from its CSV and JSON."""
    folder = scratch_path(spark, "wind")
    write_json(_measurements(spark, sf_dir), f"{folder}/pages")
    _stations(spark, sf_dir).select(
        F.concat_ws("\n", "station", F.concat(F.lit("Laius: "), "latitude"), F.concat(F.lit("Pikkus: "), "longitude"))
    ).write.text(f"{folder}/stations")
    process_wind(spark, f"{folder}/pages", f"{folder}/stations", f"{folder}/out", 1997, "DWSX", "jsonl")
    columns = ["jaam_nimi", "latitude", F.col("o_orderkey").cast("bigint"), F.col("vaartus").cast("double")]
    csv = read_csv(spark, f"{folder}/out/csv", None).select(*columns, F.lit("csv").alias("source"))
    return csv.unionByName(
        spark.read.json(f"{folder}/out/json").select(*columns, F.lit("json").alias("source"))
    )


def wind_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = wind_statistics(_measurements(spark, sf_dir))
    return stats.withColumn("mean_speed", F.round("mean_speed", 6))


def station_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = station_summary(_measurements(spark, sf_dir), _stations(spark, sf_dir))
    return rows.withColumn("mean_speed", F.round("mean_speed", 6))


def monthly_mean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly_mean(_measurements(spark, sf_dir))
    return rows.withColumn("mean_speed", F.round("mean_speed", 6))


QUERIES = {
    "station_degrees": station_degrees,
    "station_enrichment": station_enrichment,
    "stations_landed": stations_landed,
    "wind_outputs": wind_outputs,
    "page_concat": page_concat,
    "page_union": page_union,
    "csv_roundtrip": csv_roundtrip,
    "wind_global": wind_global,
    "station_summary": station_summary_query,
    "monthly_mean": monthly_mean_query,
}

# --- SQL --------------------------------------------------------------------

_CTES = f"WITH m AS ({MEASUREMENTS}), st AS ({STATIONS})"
_PAGES = f"""{_CTES}, pages AS (
  SELECT * FROM m UNION ALL SELECT * FROM m WHERE kuu <= 6)"""

_DEGREES = """SELECT s_name AS station,
        round((CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE 1 END) * (
          (s_suppkey % 89 + 1)::DOUBLE + (s_suppkey % 60)::DOUBLE / 60
          + (s_suppkey * 7 % 60)::DOUBLE / 3600), 9) AS lat_deg,
        round((CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE 1 END) * (
          (s_nationkey + 1)::DOUBLE + (s_suppkey * 3 % 60)::DOUBLE / 60
          + (s_suppkey * 11 % 60)::DOUBLE / 3600), 9) AS lon_deg
        FROM supplier"""

ORACLE = {
    "station_degrees": _DEGREES,
    "stations_landed": f"""WITH d AS ({_DEGREES}), st AS ({STATIONS})
        SELECT station, latitude, longitude, lat_deg, lon_deg FROM st JOIN d USING (station)""",
    "wind_outputs": f"""{_CTES} SELECT o_orderkey, jaam_nimi, vaartus, latitude, source
        FROM m LEFT JOIN st ON m.jaam_nimi = st.station CROSS JOIN (VALUES ('csv'), ('json')) v(source)
        WHERE aasta = 1997 AND element_kood = 'DWSX'""",
    "station_enrichment": f"""{_CTES}
        SELECT o_orderkey, jaam_nimi, vaartus, latitude, longitude
        FROM m LEFT JOIN st ON m.jaam_nimi = st.station""",
    "page_concat": f"""{_PAGES} SELECT jaam_nimi, kuu, count(*) AS measurements,
        round(max(vaartus), 6) AS max_speed
        FROM pages WHERE aasta = 1997 AND element_kood = 'DWSX' GROUP BY 1, 2""",
    "page_union": f"""{_PAGES} SELECT aasta, kuu, count(*) AS measurements
        FROM pages GROUP BY 1, 2""",
    "csv_roundtrip": f"""{_CTES}
        SELECT o_orderkey, jaam_nimi, kuu, vaartus, latitude, longitude
        FROM m LEFT JOIN st ON m.jaam_nimi = st.station""",
    "wind_global": f"""{_CTES} SELECT
        count(DISTINCT jaam_nimi) + max(CASE WHEN jaam_nimi IS NULL THEN 1 ELSE 0 END) AS stations,
        count(*) AS measurements, max(vaartus) AS max_speed, min(vaartus) AS min_speed,
        round(avg(vaartus), 6) AS mean_speed FROM m""",
    "station_summary": f"""{_CTES} SELECT jaam_nimi, round(avg(vaartus), 6) AS mean_speed,
        max(vaartus) AS max_speed, count(vaartus) AS values,
        any_value(latitude) AS latitude, any_value(longitude) AS longitude
        FROM m LEFT JOIN st ON m.jaam_nimi = st.station
        WHERE jaam_nimi IS NOT NULL GROUP BY 1""",
    "monthly_mean": f"""{_CTES} SELECT kuu, round(avg(vaartus), 6) AS mean_speed
        FROM m WHERE kuu IS NOT NULL GROUP BY 1""",
}
