from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import temporal as T
from ..plans import emissions, guards
from ..streaming import windowed_means
from .base import query, r6, table

_MONTHS = """
WITH m AS (
  SELECT l_suppkey AS cell, year(l_shipdate) AS y, month(l_shipdate) AS mo, avg(l_quantity) AS v FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL
), y AS (
  SELECT cell, y, avg(v) FILTER (WHERE mo IN (1, 2)) AS s, avg(v) FILTER (WHERE mo NOT IN (1, 2)) AS r, sum(v) AS total, count(v) AS n FROM m GROUP BY ALL
)
"""


def _months(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(T.in_years(F.col("l_shipdate"), 1996, 1998)).select(F.col("l_suppkey").alias("cell"), "l_shipdate", "l_quantity")
    return T.monthly(li, ["cell"], "l_shipdate", F.col("l_quantity"))


@query(_MONTHS + "SELECT cell, round(avg(s - r), 6) + 0.0 AS delta, round(sum(total) / sum(n), 6) AS average, CAST(sum(n) AS BIGINT) AS months, count(s - r) AS years FROM y GROUP BY cell")
def seasonal_delta(spark, sf_dir):
    """Mean of the yearly deltas and the overall mean of a cell."""
    return T.seasonal_products(_months(spark, sf_dir), ["cell"]).select("cell", r6("delta").alias("delta"), r6("average").alias("average"), "months", "years")


@query(_MONTHS + "SELECT cell, CAST(y AS INTEGER) AS year, round(s, 6) AS season, round(r, 6) AS rest, round(s - r, 6) + 0.0 AS delta FROM y")
def season_by_year(spark, sf_dir):
    """A1-A3: both sides of each year."""
    return T.yearly_season(_months(spark, sf_dir), ["cell"]).select("cell", "year", r6("season").alias("season"), r6("rest").alias("rest"), r6("delta").alias("delta"))


@query("SELECT o_orderkey, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days, round(o_totalprice * day(last_day(o_orderdate)) * 86400.0, 2) AS total FROM orders")
def monthly_totals(spark, sf_dir):
    """Rate to monthly total, leap years included."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", clean.month_days(F.col("o_orderdate")).alias("days"), F.round(clean.monthly_total(F.col("o_totalprice"), F.col("o_orderdate")), 2).alias("total"))


_BAD = """CASE WHEN l_linenumber = 7 THEN 1e20 WHEN l_linenumber = 6 THEN CAST('nan' AS DOUBLE) WHEN l_linenumber = 5 THEN -100.0 WHEN l_linenumber = 4 THEN -100.0001 ELSE l_quantity END"""


def _bad(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    v = F.when(n == 7, F.lit(1e20)).when(n == 6, F.lit(float("nan"))).when(n == 5, F.lit(-100.0)).when(n == 4, F.lit(-100.0001)).otherwise(q)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", v.alias("v"))


@query(f"SELECT l_suppkey, count(*) AS n, count(w) AS valid, round(sum(w), 4) AS total FROM (SELECT l_suppkey, CASE WHEN NOT isnan(v) AND v < 1e20 THEN v END AS w FROM (SELECT l_suppkey, {_BAD} AS v FROM lineitem)) GROUP BY 1")
def fill_mask(spark, sf_dir):
    """Fill values and NaN are missing, and are not counted."""
    return _bad(spark, sf_dir).withColumn("w", clean.mask_fill(F.col("v"))).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count("w").alias("valid"), F.round(F.sum("w"), 4).alias("total"))


@query(f"SELECT l_suppkey, count(*) AS n, count(w) AS valid, min(w) AS low FROM (SELECT l_suppkey, CASE WHEN NOT isnan(v) AND v >= -100 THEN v END AS w FROM (SELECT l_suppkey, {_BAD} AS v FROM lineitem)) GROUP BY 1")
def low_mask(spark, sf_dir):
    """-100 stays, less does not."""
    return _bad(spark, sf_dir).withColumn("w", clean.mask_low(F.col("v"))).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count("w").alias("valid"), F.min("w").alias("low"))


@query("""
WITH v AS (SELECT l_suppkey AS cell, sum(l_quantity) AS total, count(l_quantity) AS n FROM lineitem GROUP BY 1)
SELECT cell, total, n, round(total / n, 6) AS average FROM v""")
def running_mean(spark, sf_dir):
    """Sums and counts of yearly parts merge to the same mean."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), "l_shipdate", "l_quantity")
    part = lambda c: li.where(c).groupBy("cell").agg(F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("total"), F.count("l_quantity").alias("n"))
    cut = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return T.merge_running(part(cut), part(~cut), ["cell"]).withColumn("average", r6(F.col("total") / F.col("n")))


@query("""
WITH c AS (
  SELECT CAST(p % 20 AS INTEGER) AS col, CAST(p // 20 AS INTEGER) AS row, year(t) AS y, month(t) AS mo, avg(v * day(last_day(t)) * 86400.0) AS v
  FROM (SELECT l_suppkey % 100 AS p, l_shipdate AS t, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01') GROUP BY ALL
), y AS (SELECT row, col, y, avg(v) FILTER (WHERE mo IN (1, 2)) - avg(v) FILTER (WHERE mo NOT IN (1, 2)) AS d, sum(v) AS s, count(v) AS n FROM c GROUP BY ALL)
SELECT row, col, round(CAST(avg(d) AS DOUBLE), 0) + 0.0 AS delta, round(CAST(sum(s) / sum(n) AS DOUBLE), 0) AS average FROM y GROUP BY ALL""")
def emission_product(spark, sf_dir):
    """Trace A: sentinels, units, season and mean of a small grid, in one plan."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 100).alias("p"), F.col("l_shipdate").alias("t"), F.when(F.col("l_linenumber") == 7, 1e30).otherwise(F.col("l_quantity")).alias("value"))
    cells = li.select((F.col("p") / 20).cast("int").alias("row"), (F.col("p") % 20).cast("int").alias("col"), "t", "value")
    months = emissions.emission_months(cells, 1996, 1998).groupBy("row", "col", "year", "month").agg(F.avg("value").alias("value"))
    return T.seasonal_products(months, ["row", "col"]).select("row", "col", (F.round("delta", 0) + F.lit(0.0)).alias("delta"), F.round("average", 0).alias("average"))


@query("SELECT CAST(y AS INTEGER) AS year FROM range(1993, 2004) r(y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)")
def missing_years(spark, sf_dir):
    """Expected years without data."""
    return guards.missing_years(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")), 1993, 2003)


@query("""SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM range(1995, 2003) r(y), (VALUES (1), (2)) v(m)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE year(o_orderdate) = y AND month(o_orderdate) = m)""")
def missing_months(spark, sf_dir):
    """expected months of the season without data."""
    return guards.missing_months(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")), 1995, 2002)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, round(avg(value), 6) AS average, count(value) AS n FROM events GROUP BY 1, 2")
def streamed_means(spark, sf_dir):
    """Tumbling daily means from a file stream, with a watermark; every file is there at once, so nothing is late."""
    from uuid import uuid4

    schema = table(spark, sf_dir, "events").schema
    name = f"means_{uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = windowed_means(stream, "ts", "value", ["event_type"], late="3650 days")
    q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", r6("average").alias("average"), "n")
