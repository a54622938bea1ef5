"""File sources and sinks of the news and wind jobs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeledger import schemas
from galeledger.functions.geo import dms_to_degrees
from galeledger.operators.prepare import assemble_transcript
from galeledger.vocab import WIND_ELEMENT, WIND_YEAR

Path = str | Sequence[str]


def read_records(
    spark: SparkSession, path: Path, schema: T.StructType | None, fmt: str = "json"
) -> DataFrame:
    """Records with an explicit schema: ``json`` (one array or object per file),
    ``jsonl`` (one object per line, splittable) or ``parquet``. Without a schema all
    fields that occur are read, at the price of one more pass over JSON."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "json":
        return reader.json(path, multiLine=True)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(*([path] if isinstance(path, str) else path))
    raise ValueError(f"unknown format {fmt!r}")


def read_articles(spark: SparkSession, path: Path, fmt: str = "json") -> DataFrame:
    """Articles ``(date, url, text)``."""
    return read_records(spark, path, schemas.ARTICLE, fmt)


def read_measurements(
    spark: SparkSession,
    path: Path,
    year: int | None = WIND_YEAR,
    element: str | None = WIND_ELEMENT,
    fmt: str = "json",
    schema: T.StructType | None = schemas.MEASUREMENT,
) -> DataFrame:
    """All landed pages of measurements, of one year and element.

    ``schema`` may name more fields than the jobs use; ``None`` keeps whatever fields
    the pages have. The known fields have their types in any case.
    """
    rows = read_records(spark, path, schema, fmt)
    if schema is None:
        known = {f.name: f.dataType for f in schemas.MEASUREMENT}
        absent = [F.lit(None).cast(t).alias(n) for n, t in known.items() if n not in rows.columns]
        rows = rows.select(
            *[F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in rows.columns],
            *absent,
        )
    if year is not None:
        rows = rows.filter(F.col("aasta") == year)
    if element is not None:
        rows = rows.filter(F.col("element_kood") == element)
    return rows


# Labels and code prefixes of the station list.
_LATITUDE, _LONGITUDE = "Laius:", "Pikkus:"
_CODE_PREFIX = "AJ"
_NAMED_CODES = {"AJKURE_L": "Kuressaare"}


def read_stations(spark: SparkSession, path: Path) -> DataFrame:
    """Stations from text blocks of a name line, coordinate lines and a code line.

    A coordinate belongs to the last name above it in the same file; a station
    listed twice keeps its last coordinates.
    """
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path")
    lines = files.select(
        "file_path", F.posexplode(F.split("value", r"\R")).alias("pos", "raw")
    ).select("file_path", "pos", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("line"))
    line = F.col("line")
    labelled = line.contains(_LATITUDE) | line.contains(_LONGITUDE)
    name = F.when(~line.startswith(_CODE_PREFIX) & ~labelled, line)
    for code, station in _NAMED_CODES.items():
        name = F.when(line.startswith(code), F.lit(station)).otherwise(name)
    above = Window.partitionBy("file_path").orderBy("pos")
    coordinates = (
        lines.filter(line != "")
        .withColumn("station", F.last(name, ignorenulls=True).over(above))
        .filter(F.col("station").isNotNull())
        .filter(line.startswith(_LATITUDE) | line.startswith(_LONGITUDE))
    )
    at = F.struct("file_path", "pos")

    def last_with(label: str):
        value = F.trim(F.replace(line, F.lit(label), F.lit("")))
        labelled = line.startswith(label)
        return F.max_by(F.when(labelled, value), F.when(labelled, at))

    return coordinates.groupBy("station").agg(
        last_with(_LATITUDE).alias("latitude"), last_with(_LONGITUDE).alias("longitude")
    ).select(
        "station",
        "latitude",
        "longitude",
        dms_to_degrees(F.col("latitude")).alias("lat_deg"),
        dms_to_degrees(F.col("longitude")).alias("lon_deg"),
    )


def read_archive_contents(
    spark: SparkSession,
    path: Path,
    content: T.StructType | None = schemas.CONTENT,
    fmt: str = "json",
) -> DataFrame:
    """One row per record listed in the landed archive responses of all months, with
    the fields of ``content`` or, for ``None``, all fields that occur."""
    response = content and T.StructType().add(
        "seriesList", T.StructType().add("contents", T.ArrayType(content))
    )
    return read_records(spark, path, response, fmt).select(F.inline("seriesList.contents"))


def read_transcripts(spark: SparkSession, path: Path, fmt: str = "jsonl") -> DataFrame:
    """``(url, transcript, landed)`` of landed ``{url, response}`` records.

    The text is in the first element of the response; a failed request, landed
    without one, gives a null transcript. ``landed`` orders files by time and path.
    """
    landed = T.StructType().add("url", T.StringType()).add(
        "response", T.ArrayType(schemas.TRANSCRIPT_PAGE)
    )
    pages = read_records(spark, path, landed, fmt)
    return pages.select(
        "url",
        assemble_transcript(F.get("response", F.lit(0))["data"]).alias("transcript"),
        F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("landed"),
    )


#: A line that doesn't end inside a quoted field.
_CLOSED_LINE = r'^(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?(?:,|$))*+$'


def fields_have_breaks(spark: SparkSession, path: Path) -> bool:
    """Whether a line of the files ends inside a quoted field, by one pass over the lines
    that ends at the first one found in each task."""
    lines = spark.read.text(path)
    return not lines.filter(~F.col("value").rlike(_CLOSED_LINE)).isEmpty()


def largest_file(spark: SparkSession, path: Path) -> int:
    """Bytes of the largest file, from the listing."""
    files = spark.read.format("binaryFile").load(path)
    return files.agg(F.max("length")).first()[0] or 0


def split_bytes(spark: SparkSession) -> int:
    """Files up to this size are one task for any reader."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    number, unit = re.fullmatch(r"(\d+)\s*([a-zA-Z]*)", size.strip()).groups()
    return int(number) << 10 * "bkmgtp".index((unit.lower() or "b")[0])


def read_csv(
    spark: SparkSession, path: Path, schema: T.StructType | None, multiline: bool | None = None
) -> DataFrame:
    """Headered CSV, empty fields missing. Without a schema all fields are text.

    Files with line breaks inside fields (``multiline``) are one task each, others are
    split. By default the data decide: where a file is larger than a split, its lines are
    looked through for one that ends inside a field.
    """
    if multiline is None:
        multiline = largest_file(spark, path) <= split_bytes(spark) or fields_have_breaks(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True, escape='"', multiLine=multiline)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line, fields without a value as null."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Headered CSV; nested columns as JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = df.select(*[
        F.to_json(df[f"`{f.name}`"]).alias(f.name) if isinstance(f.dataType, nested) else df[f"`{f.name}`"]
        for f in df.schema
    ])
    flat.write.mode(mode).csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Classified articles written by the news job and by its stream."""
    reader = spark.read.schema(schemas.CLASSIFIED).option("recursiveFileLookup", True)
    return reader.json(f"{path}/results")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The run summary written by the news job."""
    return spark.read.schema(schemas.SUMMARY).json(f"{path}/summary")
