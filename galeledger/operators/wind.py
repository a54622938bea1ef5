"""Wind measurements with station coordinates, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_with_stations(measurements: DataFrame, stations: DataFrame) -> DataFrame:
    """Every measurement, with the coordinates of its station where known.

    ``stations`` has one row per name. A list the optimizer knows to be small is
    broadcast; a large one is shuffled and hot stations are split adaptively.
    """
    return measurements.join(
        stations.withColumnRenamed("station", "jaam_nimi"), "jaam_nimi", "left"
    )


def wind_statistics(measurements: DataFrame) -> DataFrame:
    """One row: stations, measurements, maximum, minimum and mean. Measurements
    without a station name count together as one station."""
    nameless = F.coalesce(F.max(F.col("jaam_nimi").isNull().cast("int")), F.lit(0))
    return measurements.agg(
        (F.count_distinct("jaam_nimi") + nameless).alias("stations"),
        F.count("*").alias("measurements"),
        F.max("vaartus").alias("max_speed"),
        F.min("vaartus").alias("min_speed"),
        F.avg("vaartus").alias("mean_speed"),
    )


def station_summary(measurements: DataFrame, stations: DataFrame) -> DataFrame:
    """Mean, maximum and number of values per named station, with coordinates.

    Aggregating before the join leaves one row per station to join.
    """
    per_station = (
        measurements.filter(F.col("jaam_nimi").isNotNull())
        .groupBy("jaam_nimi")
        .agg(
            F.avg("vaartus").alias("mean_speed"),
            F.max("vaartus").alias("max_speed"),
            F.count("vaartus").alias("values"),
        )
    )
    return enrich_with_stations(per_station, stations)


def monthly_mean(measurements: DataFrame) -> DataFrame:
    """Mean value per month, in month order."""
    return (
        measurements.filter(F.col("kuu").isNotNull())
        .groupBy("kuu")
        .agg(F.avg("vaartus").alias("mean_speed"))
        .orderBy("kuu")
    )
