"""Completeness and consistency checks that stop a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import VAR_TYPES


def missing_years(files: DataFrame, first: int, last: int) -> DataFrame:
    """``year``: expected years without a row in ``files``."""
    wanted = files.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return wanted.join(files.select(F.col("year").cast("int").alias("year")).distinct(), "year", "left_anti")


def missing_months(files: DataFrame, first: int, last: int, months: tuple[int, ...] = (1, 2)) -> DataFrame:
    """``year, month``: expected months of a season without a row."""
    years = files.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    wanted = years.withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    return wanted.join(files.select(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).distinct(), ["year", "month"], "left_anti")


def require_none(missing: DataFrame, what: str) -> None:
    """Raises with the first of the missing rows."""
    rows = missing.orderBy(*missing.columns).limit(20).collect()
    if rows:
        raise ValueError(f"missing {what}: " + ", ".join("-".join(str(v) for v in r) for r in rows))


def grid_problems(grids: DataFrame) -> DataFrame:
    """Rows of ``grids (crs, transform, width, height, ...)`` that no plan can use, with the reason in ``problem``."""
    a, e = F.col("transform")[0], F.col("transform")[4]
    bad = F.when(F.coalesce(F.trim("crs"), F.lit("")) == "", "no CRS").when(F.coalesce(a * e, F.lit(0.0)) == 0, "cells without area")
    bad = bad.when((F.coalesce("width", F.lit(0)) < 1) | (F.coalesce("height", F.lit(0)) < 1), "no cells")
    return grids.withColumn("problem", bad).where("problem is not null")


def unknown_types(layers: DataFrame, column: str = "var_type") -> DataFrame:
    """Rows whose variable type is none of the known ones."""
    return layers.where(~F.coalesce(F.col(column).isin(*VAR_TYPES), F.lit(False)))


def shapes(cells: DataFrame, key: str) -> DataFrame:
    """``key, height, width`` of each input."""
    return cells.groupBy(key).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def require_one_shape(cells: DataFrame, key: str) -> None:
    n = shapes(cells, key).agg(F.countDistinct("height", "width")).first()[0]
    if n > 1:
        raise ValueError(f"the inputs have {n} different grid shapes")
