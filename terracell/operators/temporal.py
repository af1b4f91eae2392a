"""Season against rest of year, and multi-year means, per cell.

One exchange on the cell serves both levels: rows are dealt by cell once, and the yearly
and the overall aggregate both find them there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heating season (fixed values).
HEATING_MONTHS = (1, 2)


def in_years(t: Column, first: int, last: int) -> Column:
    """A half-open range on ``t``, which reaches the scan as a range; ``year(t)`` would not."""
    return (t >= F.lit(f"{first}-01-01").cast("timestamp_ntz")) & (t < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz"))


def monthly(df: DataFrame, keys: list[str], t: str, value: Column, how=F.avg) -> DataFrame:
    """``keys, year, month, value``: one value per cell and month."""
    return df.groupBy(*keys, F.year(t).alias("year"), F.month(t).alias("month")).agg(how(value).alias("value"))


def yearly_season(months: DataFrame, keys: list[str], season: tuple[int, ...] = HEATING_MONTHS) -> DataFrame:
    """``keys, year, season, rest, delta, total, n`` from monthly values; missing values are skipped, and a delta needs both sides."""
    inside = F.col("month").isin(*season)
    y = months.groupBy(*keys, "year").agg(
        F.avg(F.when(inside, F.col("value"))).alias("season"), F.avg(F.when(~inside, F.col("value"))).alias("rest"),
        F.sum("value").alias("total"), F.count("value").alias("n"),
    )
    return y.withColumn("delta", F.col("season") - F.col("rest"))


def seasonal_products(months: DataFrame, keys: list[str], season: tuple[int, ...] = HEATING_MONTHS, partitioned: bool = True) -> DataFrame:
    """``keys, delta, average, months, years``: mean of the yearly deltas, and the mean over all months with a value.

    The mean over months is not balanced by year: it is sum over count of all of them.  A cell without a full
    year has a NULL delta; one without values a NULL average.  ``partitioned``: deal the rows by cell first, so both levels share one exchange.
    """
    rows = months.repartition(*keys) if partitioned else months
    y = yearly_season(rows, keys, season)
    return y.groupBy(*keys).agg(
        F.avg("delta").alias("delta"), F.try_divide(F.sum("total"), F.sum("n")).alias("average"), F.sum("n").alias("months"), F.count("delta").alias("years")
    )


def merge_running(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sum and count states ``keys, total, n`` of two parts as one; the mean is ``total / n``."""
    return a.select(*keys, "total", "n").unionByName(b.select(*keys, "total", "n")).groupBy(*keys).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.sum("n").alias("n"))
