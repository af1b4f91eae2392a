"""Administrative keys and indicator tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NA_TOKENS, decimal_comma, null_tokens, strip, zfill


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names without surrounding space, in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def valid_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key: trimmed, not missing, not empty and not ``nan`` in any case."""
    k = strip(F.col(key).cast("string"))
    return df.withColumn(key, null_tokens(k, NA_TOKENS)).where(F.col(key).isNotNull() & (F.lower(F.col(key)) != "nan") & (F.col(key) != ""))


def key_width(*tables: tuple[DataFrame, str]) -> int:
    """Longest key over all tables, after trimming."""
    lengths = reduce(DataFrame.unionByName, [d.select(F.max(F.length(strip(F.col(k).cast("string")))).alias("n")) for d, k in tables])
    return lengths.agg(F.max("n")).first()[0] or 0


def pad_keys(df: DataFrame, key: str, width: int) -> DataFrame:
    return df.withColumn(key, zfill(strip(F.col(key).cast("string")), width))


def pad_together(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """All tables with their keys zero-padded to one common width."""
    width = key_width(*tables)
    return [pad_keys(d, k, width) for d, k in tables]


def indicators(df: DataFrame, key: str = "ID") -> DataFrame:
    """An all-text table with valid keys and every other column as a number with decimal comma."""
    if key not in df.columns:
        raise ValueError(f"no key column {key!r}")
    rows = valid_keys(df, key)
    return rows.select(key, *[(decimal_comma(null_tokens(F.col(f"`{c}`"))) if t == "string" else F.col(f"`{c}`").cast("double")).alias(c) for c, t in rows.dtypes if c != key])


def join_values(features: DataFrame, values: DataFrame, feature_key: str = "dicofre", value_key: str = "ID") -> DataFrame:
    """Every feature with its values; both keys stay, and repeated keys fan out.

    No hint: the planner broadcasts the indicator table when its size allows, and shuffles both sides otherwise.
    """
    return features.join(values, features[feature_key] == values[value_key], "left")


def stack(layers: list[DataFrame]) -> DataFrame:
    """All layers by name, missing columns as NULL."""
    if not layers:
        raise ValueError("no layers")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def value_columns(df: DataFrame, *keys: str) -> list[str]:
    """The columns to present; none is an error."""
    out = [c for c in df.columns if c not in keys]
    if not out:
        raise ValueError("no value columns")
    return out


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``metric, present, missing`` of each column, in one pass."""
    n = df.agg(*[F.count(F.col(c)).alias(f"p_{i}") for i, c in enumerate(columns)], F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"p_{i}").alias("present"), (F.col("n") - F.col(f"p_{i}")).alias("missing")) for i, c in enumerate(columns)])
    return n.select(F.inline(rows))


def long_form(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, metric, value`` for each value column that has any value."""
    return df.unpivot(key, columns, "metric", "value").where("value is not null")


def key_summary(df: DataFrame, key: str, layer: str | None = None) -> DataFrame:
    """``rows, keys, repeated`` in all, or by layer."""
    g = df.groupBy(layer) if layer else df.groupBy()
    return g.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), (F.count(F.col(key)) > F.countDistinct(key)).alias("repeated"))
