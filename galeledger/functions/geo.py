"""Coordinates written in degrees, minutes and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Straight and typographic minute and second marks are both accepted.
_DMS = r"^(\d+)°(\d+)['’′](\d+)"


def dms_to_degrees(coordinate: Column) -> Column:
    """Signed decimal degrees; null where the text is not a coordinate."""
    body = F.trim(F.translate(coordinate, "NSEW", ""))
    degrees, minutes, seconds = (
        F.regexp_extract(body, _DMS, i).try_cast("double") for i in (1, 2, 3)
    )
    sign = F.when(coordinate.rlike("[SW]"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * (degrees + minutes / 60 + seconds / 3600)
