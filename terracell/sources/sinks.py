"""Exports of finished products."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .. import store
from ..model import GridSpec
from ..operators.grid import pyramid


def export(df: DataFrame, path: str, by: str = "layer", overwrite: bool = False, grid: GridSpec | None = None) -> bool:
    """One folder per value of ``by``, values as 32-bit floats; False if it is there and ``overwrite`` is off.

    The grid that the rows and columns refer to goes to ``_grid`` next to them, as a catalog row.
    """
    spark = df.sparkSession
    if not overwrite and store.exists(spark, path):
        return False
    df.withColumn("value", df["value"].cast("float")).repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
    if grid is not None:
        row = (grid.crs, list(grid.transform), grid.width, grid.height)
        spark.createDataFrame([row], "crs string, transform array<double>, width int, height int").write.parquet(f"{path}/_grid")
    return True


def exported_grid(spark: SparkSession, path: str) -> GridSpec:
    """The grid of an export."""
    return GridSpec.of(spark.read.parquet(f"{path}/_grid").first().asDict())


def jobs(spark: SparkSession, group: str) -> dict[int, str]:
    """State of each job that Spark still remembers under a job group (``SparkContext.setJobGroup``): RUNNING, SUCCEEDED, FAILED or UNKNOWN."""
    tracker = spark.sparkContext.statusTracker()
    known = {i: tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup(group)}
    return {i: info.status for i, info in sorted(known.items()) if info is not None}


def poll(spark: SparkSession, group: str, seconds: float = 60.0, every: float = 0.2) -> dict[int, str]:
    """States once no job of the group is running, or after ``seconds``."""
    end = time.monotonic() + seconds
    while not (states := jobs(spark, group)) or "RUNNING" in states.values():
        if time.monotonic() > end:
            break
        time.sleep(every)
    return states


def export_with_overviews(df: DataFrame, grid: GridSpec, path: str, how: str = "mean", levels: int | None = None, overwrite: bool = False) -> int:
    """Exports cells ``layer, row, col, value`` and 2 x 2 overviews under ``level=<n>``, until a level is one cell; returns the levels written.

    Each overview is made from the level before it as written, so no level is computed twice.
    """
    spark, n = df.sparkSession, 0
    most = max(grid.width, grid.height)
    while True:
        at = f"{path}/level={n}"
        if overwrite or not store.exists(spark, at):
            df.write.mode("overwrite").parquet(at)
        if most <= 1 or (levels is not None and n >= levels):
            return n + 1
        df, n, most = pyramid(spark.read.parquet(at), ["layer"], how), n + 1, -(-most // 2)
