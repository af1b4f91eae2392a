"""Collections, bands, layers and features that are kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def collection(spark: SparkSession, path: str, band: str, t: str = "t") -> DataFrame:
    """``t, row, col, value``: one band of a time-stamped stack; only its columns are read."""
    return spark.read.parquet(path).select(t, "row", "col", F.col(band).cast("double").alias("value"))


def between(df: DataFrame, t: str, start: str, end: str) -> DataFrame:
    """Half-open date range, as a range predicate that reaches the scan."""
    kind = df.schema[t].dataType.simpleString()
    return df.where((F.col(t) >= F.lit(start).cast(kind)) & (F.col(t) < F.lit(end).cast(kind)))


def collection_size(df: DataFrame, t: str = "t") -> DataFrame:
    return df.agg(F.countDistinct(t).alias("images"))


def first_image(df: DataFrame, t: str = "t") -> DataFrame:
    """The rows of the earliest time: one aggregate, then a join on its single row."""
    first = df.agg(F.min(t).alias("_first"))
    return df.join(F.broadcast(first), F.col(t) == F.col("_first"), "left_semi")


def layer(cells: DataFrame, name: str) -> DataFrame:
    return cells.where(F.col("layer") == name)


def features_named(features: DataFrame, attribute: str, name: str) -> DataFrame:
    return features.where(F.col(attribute) == name)


def concat_bands(bands: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """``keys`` and a column per band: one union and one aggregate, so a cell of any band is there."""
    tagged = [d.select(*keys, F.lit(n).alias("_band"), F.col("value").cast("double").alias("value")) for n, d in bands.items()]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("_band") == n, F.col("value"))).alias(n) for n in bands])


def with_rules(df: DataFrame, rules: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Rows with the columns of their rule, or defaults; ``rules`` has one row per key and is broadcast by the planner when small."""
    r = rules.select(F.col(key).alias("_rule"), *[F.col(c).alias(f"_{c}") for c in defaults])
    out = df.join(r, F.col(key) == F.col("_rule"), "left")
    return out.select(*[F.col(c) for c in df.columns], *[F.coalesce(F.col(f"_{c}"), d).alias(c) for c, d in defaults.items()])
