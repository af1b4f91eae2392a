from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..model import GridSpec
from ..operators import grid as G
from ..sources import catalog as C
from .base import query, r6, table


def _stack(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("t"), F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("value"))


@query("SELECT count(DISTINCT l_shipdate) AS images FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'")
def collection_size(spark, sf_dir):
    """Images of a date range."""
    return C.collection_size(C.between(_stack(spark, sf_dir), "t", "1996-01-01", "1997-01-01"))


@query("SELECT l_shipdate AS t, l_suppkey AS row, l_linenumber AS col, l_quantity AS value FROM lineitem WHERE l_shipdate = (SELECT min(l_shipdate) FROM lineitem)")
def first_image(spark, sf_dir):
    """The earliest image."""
    return C.first_image(_stack(spark, sf_dir))


@query("SELECT l_suppkey AS row, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS first, max(l_tax) FILTER (WHERE l_linenumber = 2) AS second FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1")
def band_concat(spark, sf_dir):
    """Bands side by side on the same cells."""
    li = table(spark, sf_dir, "lineitem")
    one = li.where("l_linenumber = 1").select(F.col("l_suppkey").alias("row"), F.col("l_quantity").alias("value"))
    two = li.where("l_linenumber = 2").select(F.col("l_suppkey").alias("row"), F.col("l_tax").alias("value"))
    return C.concat_bands({"first": one, "second": two}, ["row"])


@query("SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)")
def named_features(spark, sf_dir):
    """Features by attribute."""
    name = table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    f = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return C.features_named(f, "r_name", name).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_regionkey AS kind, CASE n_regionkey WHEN 1 THEN 1000.0 ELSE 500.0 END AS resolution, CASE n_regionkey WHEN 1 THEN 'bilinear' ELSE 'nearest' END AS resampling FROM nation")
def rule_join(spark, sf_dir):
    """Rules by key, with defaults."""
    rules = spark.createDataFrame([(1, 1000.0, "bilinear")], "kind int, resolution double, resampling string")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("kind"))
    return C.with_rules(n, rules, "kind", {"resolution": F.lit(500.0), "resampling": F.lit("nearest")})


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_acctbal WHEN 1 THEN 1500.0 WHEN 2 THEN -0.5 END AS v FROM customer")
def coerced_numbers(spark, sf_dir):
    """Text to numbers, bad text to NULL."""
    k = F.col("c_custkey") % 5
    s = F.when(k == 0, F.col("c_acctbal").cast("string")).when(k == 1, " 1.5e3 ").when(k == 2, "-.5").when(k == 3, "7d").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", T.to_number(s).alias("v"))


@query("SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, -10.0 + 0.5 * c AS west, 45.0 - 0.5 * (r + 1) AS south FROM (SELECT unnest(range(0, max(p_partkey) // 50 + 1)) AS r FROM part), range(0, 50) b(c)")
def cell_polygons(spark, sf_dir):
    """A GeoJSON polygon per cell of the parts' raster, by its first corner."""
    h = table(spark, sf_dir, "part").agg(F.floor(F.max("p_partkey") / 50) + 1).first()[0]
    p = G.cell_polygons(spark, GridSpec.square("EPSG:4326", -10.0, 45.0, 0.5, 50, h), max_cells=50 * h)
    corner = F.from_json("geometry", "coordinates array<array<array<double>>>")["coordinates"][0][0]
    return p.select("row", "col", corner[0].alias("west"), corner[1].alias("south"))


@query("SELECT CAST(p_partkey % 50 // 8 AS INTEGER) AS tile_col, CAST(p_partkey // 50 // 8 AS INTEGER) AS tile_row, count(*) AS cells, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY ALL")
def tile_blocks(spark, sf_dir):
    """Blocks of a tiled raster."""
    p = table(spark, sf_dir, "part")
    tile = G.tile_of((F.col("p_partkey") / 50).cast("int"), (F.col("p_partkey") % 50).cast("int"), 8)
    return p.withColumn("t", tile).groupBy(F.col("t.tile_col").alias("tile_col"), F.col("t.tile_row").alias("tile_row")).agg(F.count("*").alias("cells"), r6(F.avg("p_retailprice"), 4).alias("mean"))
