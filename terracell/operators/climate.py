"""Exposure indices from daily values: days beyond thresholds, and trimmed extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds in Celsius, and the ranks that the extremes average.
COLD, HOT, FIRST_RANK, LAST_RANK = 18.0, 25.0, 6, 10


def yearly_indices(daily: DataFrame, keys: list[str], value: str = "value", year: str = "year", cold: float = COLD, hot: float = HOT,
                   first: int = FIRST_RANK, last: int = LAST_RANK) -> DataFrame:
    """``keys, year, hdd_18, cdd_25, extreme_heat, extreme_cold``.

    The first two count days strictly below ``cold`` and above ``hot``; they are NULL without any value.  The extremes average the
    ranks ``first`` to ``last`` from the hottest and the coldest day; with fewer days what there is of these ranks, NULL without any.

    A year has at most 366 values in a group, so they are sorted once in an array and sliced from both ends.
    """
    v = F.col(value)
    size = last - first + 1
    days = F.sort_array(F.collect_list(v))
    g = daily.groupBy(*keys, year).agg(
        F.sum(F.when(v < cold, 1).when(v.isNotNull(), 0)).alias("hdd_18"), F.sum(F.when(v > hot, 1).when(v.isNotNull(), 0)).alias("cdd_25"), days.alias("_days")
    )
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))
    coldest = F.slice("_days", first, size)
    hottest = F.slice(F.reverse("_days"), first, size)
    return g.select(*keys, year, "hdd_18", "cdd_25", mean(hottest).alias("extreme_heat"), mean(coldest).alias("extreme_cold"))


def ranked_extremes(daily: DataFrame, keys: list[str], value: str = "value", year: str = "year", first: int = FIRST_RANK, last: int = LAST_RANK) -> DataFrame:
    """The extremes of :func:`yearly_indices` by window ranks, for groups too large for an array."""
    rows = daily.where(F.col(value).isNotNull())
    by = Window.partitionBy(*keys, year)
    ranked = rows.withColumn("_hot", F.row_number().over(by.orderBy(F.col(value).desc()))).withColumn("_cold", F.row_number().over(by.orderBy(F.col(value).asc())))
    pick = lambda c: F.avg(F.when(F.col(c).between(first, last), F.col(value)))
    return ranked.groupBy(*keys, year).agg(pick("_hot").alias("extreme_heat"), pick("_cold").alias("extreme_cold"))


def mean_over_years(yearly: DataFrame, keys: list[str], columns: tuple[str, ...] = ("hdd_18", "cdd_25", "extreme_heat", "extreme_cold")) -> DataFrame:
    """Unweighted mean of yearly values; years without one are skipped."""
    return yearly.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def climate_indices(daily: DataFrame, keys: list[str], t: str = "t", value: str = "value", mask: DataFrame | None = None) -> DataFrame:
    """All four indices as means over years, masked last: the semi join meets the aggregated rows only."""
    rows = daily.withColumn("year", F.year(t)).repartition(*keys)
    out = mean_over_years(yearly_indices(rows, keys, value), keys)
    return out if mask is None else out.join(mask.select(*keys).distinct(), keys, "left_semi")
