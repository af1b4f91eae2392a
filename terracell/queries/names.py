from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mollweide as M
from ..functions import text as T
from ..plans import emissions
from ..sources import listing
from .base import query, table


def _paths(spark, sf_dir):
    """File names made from orders: several files a year, some of other years."""
    o = table(spark, sf_dir, "orders")
    ym = F.date_format("o_orderdate", "yyyyMM")
    return o.select(F.concat(F.lit("/raw/oc/emis_"), F.date_format("o_orderdate", "yyyy"), F.lit("_v"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".nc")).alias("path"), F.concat(F.lit("/raw/pm/x."), ym, F.lit("-"), ym, F.lit("_cropped.nc")).alias("monthly")).distinct()


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, max('/raw/oc/emis_' || year(o_orderdate) || '_v' || (o_orderkey % 3) || '.nc') AS path FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1")
def yearly_files(spark, sf_dir):
    """One file a year, the last name wins."""
    return listing.yearly_files(_paths(spark, sf_dir).select("path"), 1996, 1998)


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, '/raw/pm/x.' || strftime(o_orderdate, '%Y%m') || '-' || strftime(o_orderdate, '%Y%m') || '_cropped.nc' AS path FROM orders")
def monthly_files(spark, sf_dir):
    """Year and month from the first date of a name."""
    return listing.monthly_files(_paths(spark, sf_dir).select(F.col("monthly").alias("path")))


@query("SELECT upper(r_name) AS data_type, n_name || '.tif' AS name, '/raw/' || lower(r_name) || '/' || n_name || '.tif' AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def raster_folders(spark, sf_dir):
    """Data types from folder names; other extensions are skipped."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ext = F.when(F.col("n_nationkey") % 3 == 0, ".txt").otherwise(".tif")
    return listing.raster_folders(n.select(F.concat(F.lit("/raw/"), F.lower("r_name"), F.lit("/"), F.col("n_name"), ext).alias("path")))


@query("SELECT '/maps/' || n_name || CASE WHEN n_nationkey = 7 THEN '/CONT_aad_CAOP2016.SHP' ELSE '/island.shp' END AS path, n_nationkey = 7 AS is_mainland FROM nation")
def mainland_layer(spark, sf_dir):
    """The mainland layer by name, in any case."""
    n = table(spark, sf_dir, "nation")
    return listing.mainland_first(n.select(F.concat(F.lit("/maps/"), F.col("n_name"), F.when(F.col("n_nationkey") == 7, "/CONT_aad_CAOP2016.SHP").otherwise("/island.shp")).alias("path")), "Cont_AAD_CAOP2016.shp")


@query("""SELECT n_nationkey, regexp_replace(regexp_replace(n_name || ' é/' || n_nationkey || '?!', '[^\\w\\-\\. é]+', '_', 'g'), '\\s+', '_', 'g')[1:150] AS safe, n_name || '_reprojected_to_' || 'target_grid__share.tif' AS aligned,
'PT_' || n_name || '_ERA5L_skinT_dailyMean_2010_2012_nativegrid' AS export, n_name AS stem FROM nation""")
def file_names(spark, sf_dir):
    """Names of outputs."""
    n = table(spark, sf_dir, "nation")
    path = F.concat(F.lit("/raw/x/"), F.col("n_name"), F.lit(".tiff"))
    return n.select("n_nationkey", T.safe_filename(F.concat(F.col("n_name"), F.lit(" é/"), F.col("n_nationkey").cast("string"), F.lit("?!"))).alias("safe"), T.aligned_name(path, F.lit("/y/target.TIF"), "share").alias("aligned"), T.export_name(F.col("n_name"), 2010, 2012).alias("export"), T.stem(path).alias("stem"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS mollweide, CASE n_nationkey % 5 WHEN 4 THEN 'None' WHEN 0 THEN 'ESRI:54009' WHEN 1 THEN 'PROJCS["World_Mollweide"]' WHEN 2 THEN '+proj=moll +lon_0=0' ELSE 'EPSG:4326' END AS label FROM nation""")
def crs_names(spark, sf_dir):
    """Is it Mollweide, and its label."""
    k = F.col("n_nationkey") % 5
    crs = F.when(k == 0, "ESRI:54009").when(k == 1, 'PROJCS["World_Mollweide"]').when(k == 2, "+proj=moll +lon_0=0").when(k == 3, "EPSG:4326")
    return table(spark, sf_dir, "nation").select("n_nationkey", M.is_mollweide(crs).alias("mollweide"), M.crs_label(crs).alias("label"))


@query("SELECT p_partkey, p_partkey / 8.0 AS scale, CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0.0 END AS shear, -p_partkey / 4.0 AS origin FROM part")
def wkt_affine(spark, sf_dir):
    """Six numbers from parameters in text, with defaults."""
    k = F.col("p_partkey")
    shear = F.when(k % 2 == 0, F.lit('PARAMETER["elt_0_1", 0.25],')).otherwise("")
    wkt = F.concat(F.lit('PARAM_MT["Affine", PARAMETER["num_row", 3], PARAMETER["elt_0_0", '), (k / 8.0).cast("string"), F.lit("],"), shear, F.lit('PARAMETER["elt_0_2", '), (-k / 4.0).cast("string"), F.lit('], PARAMETER["elt_1_1", -1.0], PARAMETER["elt_1_2", 5.0]]'))
    a = T.affine_of_wkt(wkt)
    return table(spark, sf_dir, "part").select("p_partkey", a[0].alias("scale"), a[1].alias("shear"), (a[2] + F.lit(0.0)).alias("origin"))


_NAMES = "CASE p_partkey % 11 WHEN 0 THEN 'res' WHEN 1 THEN 'PM2_5' WHEN 2 THEN 'pm25_total' WHEN 3 THEN 'spm' ELSE 'v' || p_partkey END"


@query(f"""WITH v AS (SELECT p_size AS path, p_partkey AS position, {_NAMES} AS name, p_partkey % 3 <> 0 AS num FROM part WHERE p_size % 10 <> 7 OR p_partkey % 3 = 0),
s AS (SELECT *, 10 * contains(lower(name), 'pm25')::INT + 9 * (contains(lower(name), 'pm_25') OR contains(lower(name), 'pm2_5'))::INT + 3 * contains(lower(name), 'pm')::INT AS score FROM v),
e AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY name = 'res' DESC, num DESC, position) AS r FROM v),
c AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY num DESC, CASE WHEN num THEN score END DESC, CASE WHEN num THEN name END DESC, position) AS r FROM s)
SELECT e.path, e.name AS emission, c.name AS pm25 FROM e JOIN c ON e.path = c.path WHERE e.r = 1 AND c.r = 1""")
def chosen_variables(spark, sf_dir):
    """The variable of each file by rule; some files have no numeric one."""
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, "res").when(k % 11 == 1, "PM2_5").when(k % 11 == 2, "pm25_total").when(k % 11 == 3, "spm").otherwise(F.concat(F.lit("v"), k.cast("string")))
    p = table(spark, sf_dir, "part").where((F.col("p_size") % 10 != 7) | (k % 3 == 0))
    v = p.select(F.col("p_size").alias("path"), k.alias("position"), name.alias("name"), F.when(k % 3 == 0, "string").otherwise("float32").alias("dtype"))
    a, b = (emissions.chosen_variables(v, r).withColumnRenamed("name", r) for r in ("emission", "pm25"))
    return a.join(b, "path")
