"""Wind job: land measurements with coordinates and summarise them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from galeledger.operators.wind import (
    enrich_with_stations,
    monthly_mean,
    station_summary,
    wind_statistics,
)
from galeledger.session import materialise
from galeledger.sources.files import read_measurements, read_stations, write_csv, write_json
from galeledger.vocab import WIND_ELEMENT, WIND_YEAR


def process_wind(
    spark: SparkSession,
    pages_path: str,
    stations_path: str,
    output_path: str,
    year: int = WIND_YEAR,
    element: str = WIND_ELEMENT,
    fmt: str = "json",
    schema: T.StructType | None = None,
) -> dict[str, DataFrame]:
    """Write the enriched measurements as JSON and CSV and return their reports.

    Both outputs have all fields of the pages, or those of ``schema``, which spares the
    pass that finds them. The pages are parsed into one Parquet table, from which the
    outputs and the reports read the columns they need.
    """
    stations = read_stations(spark, stations_path)
    pages = read_measurements(spark, pages_path, year, element, fmt, schema)
    coordinates = stations.select("station", "latitude", "longitude")
    measurements = materialise(enrich_with_stations(pages, coordinates), "measurements")
    write_json(measurements, f"{output_path}/json")
    write_csv(measurements, f"{output_path}/csv")
    measurements = measurements.drop("latitude", "longitude")
    return {
        "statistics": wind_statistics(measurements),
        "stations": station_summary(measurements, coordinates),
        "months": monthly_mean(measurements),
    }
