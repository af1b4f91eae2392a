from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climate as C
from .base import query, r6, table

_DAILY = "d AS (SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_shipdate AS DATE) AS t, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)"
_YEARLY = f"""WITH {_DAILY}, k AS (
  SELECT *, row_number() OVER (PARTITION BY cell, year ORDER BY v DESC) AS h, row_number() OVER (PARTITION BY cell, year ORDER BY v) AS c FROM d
), y AS (
  SELECT cell, year, sum(CASE WHEN v < 18 THEN 1 ELSE 0 END) AS hdd_18, sum(CASE WHEN v > 25 THEN 1 ELSE 0 END) AS cdd_25,
         avg(v) FILTER (WHERE h BETWEEN 6 AND 10) AS extreme_heat, avg(v) FILTER (WHERE c BETWEEN 6 AND 10) AS extreme_cold FROM k GROUP BY ALL
)"""


def _daily(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("cell"), F.col("l_shipdate").cast("date").alias("t")).agg(F.avg("l_quantity").alias("value"))


@query(_YEARLY + "SELECT cell, year, CAST(hdd_18 AS BIGINT) AS hdd_18, CAST(cdd_25 AS BIGINT) AS cdd_25, round(extreme_heat, 6) AS extreme_heat, round(extreme_cold, 6) AS extreme_cold FROM y")
def yearly_indices(spark, sf_dir):
    """Day counts and trimmed extremes of each year."""
    y = C.yearly_indices(_daily(spark, sf_dir).withColumn("year", F.year("t")), ["cell"])
    return y.select("cell", "year", "hdd_18", "cdd_25", r6("extreme_heat").alias("extreme_heat"), r6("extreme_cold").alias("extreme_cold"))


@query(_YEARLY + "SELECT cell, round(avg(hdd_18), 6) AS hdd_18, round(avg(cdd_25), 6) AS cdd_25, round(avg(extreme_heat), 6) AS extreme_heat, round(avg(extreme_cold), 6) AS extreme_cold FROM y GROUP BY cell")
def climate_indices(spark, sf_dir):
    """Means over years."""
    out = C.climate_indices(_daily(spark, sf_dir), ["cell"])
    return out.select("cell", *[r6(c).alias(c) for c in ("hdd_18", "cdd_25", "extreme_heat", "extreme_cold")])


@query(_YEARLY + "SELECT cell, round(avg(hdd_18), 6) AS hdd_18, round(avg(extreme_heat), 6) AS extreme_heat FROM y WHERE cell IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) GROUP BY cell")
def masked_indices(spark, sf_dir):
    """The mask meets the aggregated cells only."""
    mask = table(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("cell"))
    return C.climate_indices(_daily(spark, sf_dir), ["cell"], mask=mask).select("cell", r6("hdd_18").alias("hdd_18"), r6("extreme_heat").alias("extreme_heat"))


@query(_YEARLY + "SELECT cell, year, round(extreme_heat, 6) AS extreme_heat, round(extreme_cold, 6) AS extreme_cold FROM y")
def ranked_extremes(spark, sf_dir):
    """A11, A12 by window ranks."""
    e = C.ranked_extremes(_daily(spark, sf_dir).withColumn("year", F.year("t")), ["cell"])
    return e.select("cell", "year", r6("extreme_heat").alias("extreme_heat"), r6("extreme_cold").alias("extreme_cold"))


@query("""WITH d AS (SELECT user_id AS cell, CAST(year(ts) AS INTEGER) AS year, CAST(ts AS DATE) AS t, max(value) AS v FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY cell, year ORDER BY v DESC) AS h, row_number() OVER (PARTITION BY cell, year ORDER BY v) AS c, count(*) OVER (PARTITION BY cell, year) AS n FROM d)
SELECT cell, year, round(avg(v) FILTER (WHERE h BETWEEN 6 AND 10), 6) AS extreme_heat, round(avg(v) FILTER (WHERE c BETWEEN 6 AND 10), 6) AS extreme_cold FROM k GROUP BY ALL""")
def short_years(spark, sf_dir):
    """A11, A12 with few days: fewer than six have no extreme."""
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.col("ts").cast("date").alias("t")).agg(F.max("value").alias("value"))
    y = C.yearly_indices(d.withColumn("year", F.year("t")), ["cell"])
    return y.select("cell", "year", r6("extreme_heat").alias("extreme_heat"), r6("extreme_cold").alias("extreme_cold"))
