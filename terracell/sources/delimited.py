"""Semicolon-separated indicator tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.keys import indicators


def read_indicators(spark: SparkSession, path: str, key: str = "ID", sep: str = ";") -> DataFrame:
    """All columns are read as text, so leading zeros of keys survive; then keys are checked and the rest become numbers."""
    raw = spark.read.csv(path, sep=sep, header=True, encoding="UTF-8", inferSchema=False)
    return indicators(raw.toDF(*[c.strip().lstrip("\ufeff") for c in raw.columns]), key)
