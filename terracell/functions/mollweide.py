"""Mollweide projection on the sphere of radius 6378137 m, central meridian 0, and tests of CRS names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
_ROOT2 = math.sqrt(2.0)
#: Authority name and text of the target CRS (fixed values).
CODE = "ESRI:54009"
#: Newton steps of the forward projection.
STEPS = 15


def inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees; NULL outside the ellipse."""
    # Outside, the arc sine is NaN, and so is the longitude; NaN is above every bound.
    theta = F.asin(y / (RADIUS * _ROOT2))
    lat = F.degrees(F.asin(F.least(F.greatest((2 * theta + F.sin(2 * theta)) / math.pi, F.lit(-1.0)), F.lit(1.0))))
    lon = F.degrees(F.try_divide(x * math.pi, F.cos(theta) * (2 * _ROOT2 * RADIUS)))
    inside = F.abs(lon) <= 180
    return F.when(inside, lon), F.when(inside, lat)


def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres from degrees; NULL outside -180..180 and -90..90."""
    goal = F.sin(F.radians(lat)) * math.pi
    step = lambda t, _: t - F.try_divide(2 * t + F.sin(2 * t) - goal, 2 + 2 * F.cos(2 * t))
    theta = F.when(F.abs(lat) == 90, F.radians(lat)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.radians(lat), step))
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(ok, lon * F.cos(theta) * (2 * _ROOT2 * RADIUS / 180)), F.when(ok, F.sin(theta) * (RADIUS * _ROOT2))


def is_mollweide(crs: Column) -> Column:
    """By code or by name, in any case; an unknown CRS is not."""
    return F.coalesce(F.lower(crs).contains("54009") | F.lower(crs).contains("mollweide") | F.lower(crs).rlike(r"\+proj=moll\b"), F.lit(False))


def is_mollweide_name(crs: str | None) -> bool:
    c = (crs or "").lower()
    return "54009" in c or "mollweide" in c or "+proj=moll" in c


def crs_label(crs: Column) -> Column:
    return F.coalesce(crs, F.lit("None"))
