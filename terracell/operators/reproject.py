"""Warping to the Mollweide projection: target grid from the source's outline, then sampling at inverse-projected centres."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mollweide as M
from ..functions import projections as J
from ..functions import transverse_mercator as TM
from ..model import GridSpec
from . import grid as G
from .resample import sample


#: CRS names of longitude and latitude in degrees (fixed values).
LONLAT = ("EPSG:4326", "OGC:CRS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84", "EPSG:4258")


def lonlat(crs: str):
    """(to, from) longitude and latitude for a CRS: functions of two columns.  Codes, WKT and PROJ strings that are not supported raise; other names are taken as degrees."""
    if (tm := TM.of_crs(crs)) is not None:
        return tm.inverse, tm.forward
    if M.is_mollweide_name(crs):
        return M.inverse, M.forward
    if crs.upper() not in LONLAT and (crs.upper().startswith(("EPSG:", "ESRI:", "+PROJ")) or "[" in crs):
        system = J.crs(crs)
        return (lambda x, y: J.on_columns(system.inverse(), x, y)), (lambda lon, lat: J.on_columns(system.forward(), lon, lat))
    same = lambda x, y: (x, y)
    return same, same


def mollweide_grid(spark: SparkSession, src: GridSpec, resolution: float | None = None, steps: int = 64) -> GridSpec:
    """A grid in metres around the projected outline of a grid (see :func:`lonlat` for its CRS), snapped to whole cells.

    Without a resolution a cell gets the diagonal share that the source's cells have.
    """
    xmin, ymin, xmax, ymax = src.bounds
    side = spark.range(steps + 1).select((F.col("id") / steps).alias("s"))
    along = lambda lo, hi: F.lit(lo) + F.col("s") * (hi - lo)
    edges = [(along(xmin, xmax), F.lit(ymin)), (along(xmin, xmax), F.lit(ymax)), (F.lit(xmin), along(ymin, ymax)), (F.lit(xmax), along(ymin, ymax))]
    to, _ = lonlat(src.crs)
    # Of a lon/lat grid the parallel closest to the equator is the widest.
    edges.append((along(xmin, xmax), F.lit(min(max(0.0, ymin), ymax))))
    pts = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in edges])
    p = side.select(F.explode(pts).alias("p")).select(*[c.alias(n) for c, n in zip(M.forward(*to(F.col("p.x"), F.col("p.y"))), "xy")])
    r = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if r[0] is None:
        raise ValueError("the grid is outside the projection")
    if resolution is None:
        resolution = math.hypot(r[2] - r[0], r[3] - r[1]) / math.hypot(src.width, src.height)
    left, top = math.floor(r[0] / resolution) * resolution, math.ceil(r[3] / resolution) * resolution
    return GridSpec.square(M.CODE, left, top, resolution, max(1, math.ceil((r[2] - left) / resolution)), max(1, math.ceil((top - r[1]) / resolution)))


def to_mollweide(cells: DataFrame, src: GridSpec, resolution: float | None = None, how: str = "nearest", keys: list[str] | None = None, target: GridSpec | None = None) -> tuple[DataFrame, GridSpec]:
    """(cells on the target grid, the grid); for sources of any CRS that :func:`lonlat` knows."""
    spark = cells.sparkSession
    dst = target or mollweide_grid(spark, src, resolution)
    x, y = G.centres(dst, F.col("col"), F.col("row"))
    sx, sy = lonlat(src.crs)[1](*M.inverse(x, y))
    wanted = G.cells(spark, dst).select("row", "col", sx.alias("x"), sy.alias("y"))
    return sample(cells, src, wanted, how, list(keys or [])), dst
