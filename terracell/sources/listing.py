"""File discovery as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def listing(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """``path`` of files under ``root``; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(root).select("path")


def yearly_files(paths: DataFrame, first: int, last: int) -> DataFrame:
    """``year, path``: the first year in each name, within range; of several files of a year the last name stays."""
    y = paths.withColumn("year", T.year_in_name(T.basename(F.col("path"))))
    return y.where(F.col("year").between(first, last)).groupBy("year").agg(F.max("path").alias("path"))


def monthly_files(paths: DataFrame) -> DataFrame:
    """``year, month, path`` from names ending in ``_cropped.nc``; such a name without dates raises."""
    named = paths.where(F.col("path").endswith("_cropped.nc")).withColumn("m", T.month_of_name(T.basename(F.col("path"))))
    return named.groupBy(F.col("m.year").alias("year"), F.col("m.month").alias("month")).agg(F.max("path").alias("path"))


def raster_folders(paths: DataFrame) -> DataFrame:
    """``data_type, name, path`` of the ``.tif`` and ``.tiff`` files directly in each folder; the data type is the upper-cased folder name."""
    tif = paths.where(F.col("path").rlike(r"\.tiff?$"))
    return tif.select(F.upper(T.basename(T.parent(F.col("path")))).alias("data_type"), T.basename(F.col("path")).alias("name"), "path")


def mainland_first(paths: DataFrame, mainland: str) -> DataFrame:
    """``path, is_mainland`` of ``.shp`` files; the first with the mainland's name, in any case, is it."""
    shp = paths.where(F.lower("path").endswith(".shp"))
    named = F.lower(T.basename(F.col("path"))) == mainland.lower()
    first = shp.where(named).agg(F.min("path").alias("_m"))
    return shp.join(F.broadcast(first), F.col("path") == F.col("_m"), "left").select("path", F.col("_m").isNotNull().alias("is_mainland"))


def relative_path(path, root: str):
    return F.regexp_replace(path, "^.*" + root.strip("/").replace(".", r"\.") + "/", "")
