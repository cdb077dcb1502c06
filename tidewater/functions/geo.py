"""Projection and box helpers on plain double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: sphere radius of the web mercator projection, in metres
EARTH_RADIUS_M = 6378137.0


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.log(F.tan(F.lit(0.25) * F.pi() + F.radians(lat) / 2))


def in_box(lat: Column, lon: Column, box: dict[str, Column]) -> Column:
    """Inclusive point-in-box test."""
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"])


def point_box(lat: Column, lon: Column, eps: float = 0.01) -> list[Column]:
    """A box of ``eps`` degrees on each side of a point."""
    return [
        (lat - eps).alias("lat_min"),
        (lat + eps).alias("lat_max"),
        (lon - eps).alias("lon_min"),
        (lon + eps).alias("lon_max"),
    ]
