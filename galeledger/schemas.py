"""Explicit schemas of the files and tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

#: Whole numbers as they are written in texts.
WHOLE = T.DecimalType(38, 0)

ARTICLE = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
])

CATEGORY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("matches", T.ArrayType(T.StringType())),
])

VERDICT = T.StructType([
    T.StructField("relevant", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("categories", T.ArrayType(CATEGORY)),
    T.StructField("reason", T.StringType()),
])

LOCATION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

DAMAGE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

DURATION = T.StructType([
    T.StructField("value", WHOLE),
    T.StructField("unit", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

FINANCIAL = T.StructType([
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

SEVERITY = T.StructType([
    T.StructField("affected_customers", WHOLE),
    T.StructField("duration", DURATION),
    T.StructField("financial_damage", FINANCIAL),
    T.StructField("scale", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

CLASSIFICATION = T.StructType([
    T.StructField("locations", T.ArrayType(LOCATION)),
    T.StructField("severity", SEVERITY),
    T.StructField("damage_types", T.ArrayType(DAMAGE)),
])

CLASSIFIED = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("url", T.StringType()),
    T.StructField("relevance", VERDICT),
    T.StructField("classification", CLASSIFICATION),
])

SUMMARY = T.StructType([
    T.StructField("total_articles", T.LongType()),
    T.StructField("relevant_articles", T.LongType()),
    T.StructField("relevance_rate", T.DoubleType()),
    T.StructField("processing_date", T.TimestampType()),
    T.StructField("confidence_threshold", T.DoubleType()),
])

MEASUREMENT = T.StructType([
    T.StructField("jaam_nimi", T.StringType()),
    T.StructField("aasta", T.IntegerType()),
    T.StructField("kuu", T.IntegerType()),
    T.StructField("element_kood", T.StringType()),
    T.StructField("vaartus", T.DoubleType()),
])

STATION = T.StructType([
    T.StructField("station", T.StringType()),
    T.StructField("latitude", T.StringType()),
    T.StructField("longitude", T.StringType()),
    T.StructField("lat_deg", T.DoubleType()),
    T.StructField("lon_deg", T.DoubleType()),
])

CONTENT = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("heading", T.StringType()),
    T.StructField("lead", T.StringType()),
    T.StructField("url", T.StringType()),
])

TRANSCRIPT_PAGE = T.StructType([
    T.StructField(
        "data", T.ArrayType(T.StructType([T.StructField("content", T.StringType())]))
    ),
])
