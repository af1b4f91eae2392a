"""Cells of grids: affine mapping, boxes, polygons, tile arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GridSpec

#: Cells for which polygons are made at most (fixed value).
MAX_CELLS = 50_000


def to_xy(grid: GridSpec, col: Column, row: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = grid.transform
    if not b and not d:
        return col * a + c, row * e + f
    return F.lit(c) + col * a + row * b, F.lit(f) + col * d + row * e


def to_colrow(grid: GridSpec, x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional column and row of a point: the inverse of :func:`to_xy`."""
    a, b, c, d, e, f = grid.transform
    det = a * e - b * d
    if det == 0:
        raise ValueError("the grid's transform has no inverse")
    if not b and not d:  # each side once, as callers expand these expressions
        return (x - c) / a, (y - f) / e
    dx, dy = x - c, y - f
    return (dx * e - dy * b) / det, (dy * a - dx * d) / det


def centres(grid: GridSpec, col: Column, row: Column) -> tuple[Column, Column]:
    return to_xy(grid, col + F.lit(0.5), row + F.lit(0.5))


def cells(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """``row, col`` of every cell, from one distributed range."""
    n = spark.range(grid.width * grid.height)
    return n.select((F.col("id") / grid.width).cast("long").cast("int").alias("row"), (F.col("id") % grid.width).cast("int").alias("col"))


def with_boxes(rows: DataFrame, grid: GridSpec) -> DataFrame:
    """Adds ``xmin, ymin, xmax, ymax`` to rows with ``row, col``."""
    x0, y0 = to_xy(grid, F.col("col"), F.col("row"))
    x1, y1 = to_xy(grid, F.col("col") + 1, F.col("row") + 1)
    return rows.select("*", F.least(x0, x1).alias("xmin"), F.least(y0, y1).alias("ymin"), F.greatest(x0, x1).alias("xmax"), F.greatest(y0, y1).alias("ymax"))


def cell_polygons(spark: SparkSession, grid: GridSpec, max_cells: int = MAX_CELLS) -> DataFrame | None:
    """``row, col, geometry`` with a GeoJSON polygon per cell; None for a grid of more than ``max_cells`` cells."""
    if grid.width * grid.height > max_cells:
        return None
    b = with_boxes(cells(spark, grid), grid)
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    return b.select("row", "col", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"))


def tile_of(row: Column, col: Column, size: int = 256) -> Column:
    """Block of a cell, the key by which tiled sinks partition."""
    return F.struct((row / size).cast("int").alias("tile_row"), (col / size).cast("int").alias("tile_col"))


def tiles_to_cells(df: DataFrame, array: str, width: int, keep: list[str]) -> DataFrame:
    """Row-major arrays to ``row, col, value``."""
    return df.select(*keep, F.posexplode(array).alias("_p", "value")).select(*keep, (F.col("_p") / width).cast("int").alias("row"), (F.col("_p") % width).alias("col"), F.col("value").cast("double").alias("value"))


def cells_to_tiles(df: DataFrame, width: int, height: int, keys: list[str]) -> DataFrame:
    """``keys, tile``: row-major arrays from cells; absent cells are NULL."""
    at = F.col("row") * width + F.col("col")
    held = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("k"), F.col("value").alias("v")))).alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.try_element_at("m", i)).alias("tile"))


def pyramid(df: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """The next overview level: 2 x 2 cells by ``mean``, ``mode`` or ``sample`` (the upper left cell)."""
    up = df.withColumns({"_r": F.col("row"), "_c": F.col("col")}).withColumns({"row": (F.col("row") / 2).cast("int"), "col": (F.col("col") / 2).cast("int")})
    by = [*keys, "row", "col"]
    if how == "mean":
        return up.groupBy(*by).agg(F.avg("value").alias("value"))
    if how == "sample":
        return up.groupBy(*by).agg(F.min_by("value", F.struct("_r", "_c")).alias("value"))
    if how == "mode":
        n = up.where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("_n"))
        return n.groupBy(*by).agg(F.max_by("value", F.struct(F.col("_n"), -F.col("value"))).alias("value"))
    raise ValueError(f"unknown overview rule {how!r}")
