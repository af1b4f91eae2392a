from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from .. import store
from ..model import GridSpec
from ..operators import vector as V
from ..functions import geometry as P
from ..plans import align, curate, guards, indicator_map
from ..plans import manifest as M
from ..sources import catalog as C
from ..sources import blocks, geotiff, netcdf3, shapefile, sinks
from .base import query, r6, table
from .grids import _cells, _grid, WIDTH

_AT = f"CAST(p_partkey // {WIDTH} AS INTEGER) AS row, CAST(p_partkey % {WIDTH} AS INTEGER) AS col"

#: Cells of the parts' raster that have a value.
_HELD = "p_partkey % 13 <> 0"


def _bands(spark, sf_dir):
    """Two bands of the parts' raster: prices and sizes."""
    return _cells(spark, sf_dir, "p_retailprice").withColumn("band", F.lit(1)).unionByName(_cells(spark, sf_dir, "p_size").withColumn("band", F.lit(2))).select("band", "row", "col", "value")


def _tiff(spark, sf_dir):
    """The folder of a two-band file written from the parts."""
    folder = store.new_path(spark, "layers")
    geotiff.write_layer(_bands(spark, sf_dir), _grid(spark, sf_dir), f"{folder}/parts.tif", bands=2)
    return folder


@query(f"SELECT 1 AS band, {_AT}, round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 3) AS value FROM part WHERE {_HELD} UNION ALL SELECT 2, {_AT.replace(' AS row', '').replace(' AS col', '')}, CAST(p_size AS DOUBLE) FROM part WHERE {_HELD}")
def geotiff_round_trip(spark, sf_dir):
    """Bands packed by tile, streamed into one file, and read again; NoData comes back as NULL."""
    return geotiff.read_cells(spark, _tiff(spark, sf_dir)).where("value is not null").select("band", "row", "col", r6("value", 3).alias("value"))


@query(f"SELECT 2 AS band, {_AT}, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey // {WIDTH} BETWEEN 2 AND 300 AND p_partkey % {WIDTH} BETWEEN 3 AND 19 AND {_HELD}")
def geotiff_window(spark, sf_dir):
    """A window of one band; only its blocks are unpacked."""
    return geotiff.read_cells(spark, _tiff(spark, sf_dir), window=(2, 301, 3, 20), band=2).where("value is not null").select("band", "row", "col", "value")


@query(f"SELECT 'parts.tif' AS file, CAST(band AS INTEGER) AS band, count(*) AS cells, count(v) AS held, round(sum(v), 2) AS total FROM (SELECT p_partkey, unnest([1, 2]) AS band, CASE WHEN {_HELD} THEN unnest([CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), CAST(p_size AS DOUBLE)]) END AS v FROM part WHERE p_partkey // {WIDTH} >= 1) GROUP BY ALL")
def geotiff_blocks(spark, sf_dir):
    """A file of both bands read block by block through the data source, from its second row on."""
    h = _grid(spark, sf_dir).height
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    cells = blocks.read_blocks(spark, _tiff(spark, sf_dir), window=(1, h, 0, WIDTH), partition_cells=1 << 16).where(F.col("row") * WIDTH + F.col("col") <= last)
    return cells.groupBy(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "band").agg(F.count("*").alias("cells"), F.count("value").alias("held"), F.round(F.sum("value"), 2).alias("total"))


@query(f"SELECT 'LOCAL' AS crs, {WIDTH} AS width, CAST((max(p_partkey) + {WIDTH}) // {WIDTH} AS INTEGER) AS height, 2 AS bands, -9999.0::DOUBLE AS nodata, 'float32' AS dtype, '1 x 1' AS resolution, false AS again FROM part")
def geotiff_catalog(spark, sf_dir):
    """The catalog row of a written file, its resolution label; a second write without overwrite does nothing."""
    folder = _tiff(spark, sf_dir)
    again = geotiff.write_layer(_bands(spark, sf_dir), _grid(spark, sf_dir), f"{folder}/parts.tif", bands=2)
    g = geotiff.read_grids(spark, folder)
    label = _grid(spark, sf_dir).resolution
    return g.select("crs", "width", "height", "bands", "nodata", "dtype", F.lit(label).alias("resolution"), F.lit(again).alias("again"))


@query("SELECT n_name AS dicofre, 'ESRI:54009' AS crs, 2.0 * (n_nationkey % 4 + 1) * (n_nationkey % 4 + 1) AS area FROM nation")
def shapefile_layers(spark, sf_dir):
    """Polygons, keys and CRS of a shapefile's three parts."""
    folder = store.new_path(spark, "shapes")
    rows = []
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator():  # as many rows as there are nations
        x, w = 10.0 * r["n_nationkey"], float(r["n_nationkey"] % 4 + 1)
        rows.append(({"DICOFRE": r["n_name"]}, [[[(x, 0.0), (x, 2 * w), (x + w, 2 * w), (x + w, 0.0), (x, 0.0)]]]))
    shp, dbf = shapefile.encode(rows)
    for ext, data in (("shp", shp), ("dbf", dbf), ("prj", b'PROJCS["World_Mollweide",GEOGCS["GCS_WGS_1984"]]')):
        store.write_bytes(spark, f"{folder}/nations.{ext}", [data])
    return shapefile.read_features(spark, folder).select("dicofre", "crs", P.area(F.col("geometry.polys")).alias("area"))


@query("SELECT CAST(n_nationkey // 5 AS INTEGER) AS row, CAST(n_nationkey % 5 AS INTEGER) AS col, TIMESTAMP '2010-01-01' + INTERVAL (31 * m) DAY AS t, CAST(n_nationkey * 2 + m AS DOUBLE) AS value FROM nation, range(0, 2) x(m)")
def netcdf_cells(spark, sf_dir):
    """A cube with a singleton dimension, dimensions in another order and upper-case names, as cells."""
    folder = store.new_path(spark, "cubes")
    keys = sorted(r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_nationkey").toLocalIterator())  # as many as there are nations
    plane = np.array(keys, np.float32).reshape(-1, 5)
    cube = np.stack([plane * 2 + m for m in range(2)])  # time, lat, lon
    v = {
        "TIME": netcdf3.Variable(("TIME",), np.array([0.0, 31.0]), {"units": "days since 2010-01-01 00:00:00", "calendar": "standard"}),
        "emission": netcdf3.Variable(("Longitude", "level", "TIME", "LATITUDE"), cube.transpose(2, 0, 1)[:, None], {"_FillValue": -1.0}),
    }
    store.write_bytes(spark, f"{folder}/emis_2010.nc", [netcdf3.encode(v)])
    return netcdf3.read_cells(spark, folder).select("row", "col", "t", "value")


@query("SELECT CAST(l_linenumber AS VARCHAR) AS layer, CAST(l_suppkey AS BIGINT) AS row, CAST(sum(l_quantity) AS DOUBLE) AS value, 'EPSG:4326' AS crs, 0.5 AS size, false AS again FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL")
def exported_asset(spark, sf_dir):
    """An export by layer keeps its grid; one layer of it is read again; a second export does nothing."""
    path = store.new_path(spark, "asset")
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("layer"), F.col("l_suppkey").cast("long").alias("row")).agg(F.sum("l_quantity").alias("value"))
    grid = GridSpec.square("EPSG:4326", -10.0, 45.0, 0.5, 7, 100_000)
    sinks.export(cells, path, grid=grid)
    again = sinks.export(cells.limit(0), path, grid=grid)
    held = sinks.exported_grid(spark, path)
    asset = spark.read.schema("row long, value float, layer string").parquet(path)
    return C.layer(asset, "2").select("layer", "row", F.col("value").cast("double").alias("value"), F.lit(held.crs).alias("crs"), F.lit(held.res_x).alias("size"), F.lit(again).alias("again"))


@query(f"""SELECT CAST(p_partkey // {WIDTH} // 2 AS INTEGER) AS row, CAST(p_partkey % {WIDTH} // 2 AS INTEGER) AS col, round(avg(p_retailprice), 4) AS value, 'A' AS moved FROM part WHERE {_HELD} GROUP BY 1, 2""")
def catalog_alignment(spark, sf_dir):
    """Of two rasters the finer one is reduced onto the other's grid; no resampling flag is set unless asked for."""
    g = _grid(spark, sf_dir)
    coarse = GridSpec("LOCAL", (2.0, 0.0, 0.0, 0.0, 2.0, 0.0), math.ceil(g.width / 2), math.ceil(g.height / 2))
    cells = _cells(spark, sf_dir, "p_retailprice")
    moved, label = align.align_two_by_catalog(cells, g, "continuous", cells.limit(0), coarse, "share")
    return moved.where("value is not null").select("row", "col", r6("value", 4).alias("value"), F.lit(label).alias("moved"))


@query(f"""SELECT 'lights' AS layer, 'NTL' AS data_type, 1 AS band, {_AT}, CASE WHEN {_HELD} THEN round(CAST(CAST(ln(p_retailprice + 2) AS FLOAT) AS DOUBLE), 4) END AS value FROM part
UNION ALL SELECT 'sizes', 'OTHER', 1, {_AT.replace(' AS row', '').replace(' AS col', '')}, CASE WHEN {_HELD} THEN CAST(p_size AS DOUBLE) END FROM part""")
def curated_layers(spark, sf_dir):
    """All layers of a configuration as one plan: lights are transformed, others pass as they are."""
    own = _grid(spark, sf_dir)
    g = GridSpec("ESRI:54009", own.transform, own.width, own.height)
    one = lambda v: _cells(spark, sf_dir, v).withColumn("band", F.lit(1)).select("band", "row", "col", "value")
    layers = [curate.Layer("lights", "ntl", one("p_retailprice"), g), curate.Layer("sizes", "other", one("p_size"), g)]
    cells, _, _ = curate.curate_all(layers, curate.Config("/raw", "/curated"), spark)
    return cells.select("layer", "data_type", "band", "row", "col", r6("value", 4).alias("value"))


@query("""SELECT 'sizes' AS name, 'copied' AS action, true AS copied_as_is, true AS first, false AS again, true AS same FROM region LIMIT 1""")
def copied_layer(spark, sf_dir):
    """K5: a layer that needs nothing is copied byte by byte, once, with its record."""
    folder = _tiff(spark, sf_dir)
    g = GridSpec("ESRI:54009", (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 1, 1)
    layer = curate.Layer("sizes", "other", spark.createDataFrame([], "band int, row int, col int, value double"), g, src_path=f"{folder}/parts.tif", dst_path=f"{folder}/copy/parts.tif")
    cfg = curate.Config("/raw", "/curated")
    first, record = curate.copy_as_is(spark, layer, cfg)
    again, _ = curate.copy_as_is(spark, layer, cfg)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).agg(F.countDistinct(F.sha2("content", 256)).alias("kinds"), F.count("*").alias("files"))
    row = F.lit(record["action"])
    return files.select(F.lit(record["name"]).alias("name"), row.alias("action"), (row == "copied").alias("copied_as_is"), F.lit(first).alias("first"), F.lit(again).alias("again"), ((F.col("kinds") == 1) & (F.col("files") == 2)).alias("same"))


@query("SELECT n_regionkey AS data_type, n_name AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INTEGER) AS number, CAST(count(*) OVER (PARTITION BY n_regionkey) AS INTEGER) AS of, round(100.0::DOUBLE * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) / count(*) OVER (PARTITION BY n_regionkey), 1) AS percent, CAST((SELECT count(DISTINCT n_regionkey) FROM nation) AS INTEGER) AS folders FROM nation")
def batch_progress(spark, sf_dir):
    """Folders found, and each layer's number and share of its folder."""
    return curate.progress(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("data_type"), F.col("n_name").alias("name")))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'no CRS' WHEN n_nationkey % 3 = 0 THEN 'cells without area' ELSE 'no cells' END AS problem FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 OR n_nationkey % 7 = 0""")
def grid_problems(spark, sf_dir):
    """grids that no plan can use."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(
        k, F.when(k % 5 == 0, " ").otherwise("EPSG:4326").alias("crs"), F.array(F.when(k % 3 == 0, 0.0).otherwise(1.0), *[F.lit(0.0)] * 3, F.lit(-1.0), F.lit(0.0)).alias("transform"),
        F.when(k % 7 == 0, 0).otherwise(4).alias("width"), F.lit(4).alias("height"))
    return guards.grid_problems(n).select("n_nationkey", "problem")


@query("SELECT n_nationkey, n_name AS var_type FROM nation WHERE n_nationkey % 6 = 5 OR n_nationkey % 6 = 0")
def unknown_types(spark, sf_dir):
    """F15, A24d: variable types that are none."""
    k = F.col("n_nationkey") % 6
    kinds = F.when(k == 1, "count").when(k == 2, "share").when(k == 3, "continuous").when(k == 4, "categorical").otherwise(F.col("n_name"))
    return guards.unknown_types(table(spark, sf_dir, "nation").select("n_nationkey", kinds.alias("var_type")))


@query("""WITH n AS (SELECT n_name, n_nationkey FROM nation), s AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM n WHERE n_nationkey <> 3)
SELECT CAST((SELECT count(*) FROM n WHERE n_nationkey = 3) AS INTEGER) AS kept, 'no dicofre in ' || (SELECT string_agg(n_name, ', ' ORDER BY i) FROM s WHERE i <= 20) || ' and ' || (SELECT count(*) - 20 FROM s) || ' more' AS warning""")
def skipped_layers(spark, sf_dir):
    """Layers without the key are skipped with a warning that names twenty."""
    names = [(r["n_name"], r["n_nationkey"]) for r in table(spark, sf_dir, "nation").select("n_name", "n_nationkey").orderBy("n_name").toLocalIterator()]  # layers are a short list
    layers = {name: spark.createDataFrame([], " DICOFRE string" if key == 3 else "other string") for name, key in names}
    kept, warning = indicator_map.with_key(layers)
    return spark.createDataFrame([(len(kept), warning)], "kept int, warning string")


@query("""SELECT n_regionkey AS layer, n_name AS dicofre, CASE WHEN n_nationkey % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS type, CASE WHEN n_nationkey % 2 = 0 THEN 5.0 ELSE 1.0 END AS area, CAST(n_nationkey AS DOUBLE) AS value FROM nation""")
def gathered_parishes(spark, sf_dir):
    """The parts of a parish are one geometry before the indicators join, so no row fans out; a part that is there twice counts once."""
    n = table(spark, sf_dir, "nation")
    x = F.col("n_nationkey") * 10.0
    near, far = P.rectangle(x, F.lit(0.0), x + 1, F.lit(1.0)), P.rectangle(x, F.lit(0.5), x + 2, F.lit(2.5))
    shape = lambda p: F.struct(F.lit("Polygon").alias("type"), p.alias("polys")).alias("geometry")
    rows = n.select("n_regionkey", "n_name", shape(near)).unionByName(n.select("n_regionkey", "n_name", shape(near))).unionByName(n.where("n_nationkey % 2 = 0").select("n_regionkey", "n_name", shape(far)))
    parts = V.gather_parts(rows.select(F.col("n_regionkey").alias("layer"), F.col("n_name").alias("dicofre"), "geometry"), ["layer", "dicofre"])
    values = n.select(F.col("n_name").alias("ID"), F.col("n_nationkey").cast("double").alias("value"))
    joined = parts.join(values, F.col("dicofre") == F.col("ID"), "left")
    return joined.select("layer", "dicofre", F.col("geometry.type").alias("type"), P.area(F.col("geometry.polys")).alias("area"), "value")


@query("SELECT DISTINCT strftime(o_orderdate + INTERVAL 3723 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'nodata: below -100; units: kg; season months: 01, 02, 12; delta: mean over years of (mean of the season - mean of the rest); projection: ESRI:54009' AS steps FROM orders")
def audit_steps(spark, sf_dir):
    """The steps of a seasonal product joined into one text, and stamps in UTC."""
    steps = F.array_join(M.steps_text("below -100", "kg", (1, 2, 12), "delta", "ESRI:54009"), "; ")
    at = (F.col("o_orderdate") + F.expr("INTERVAL 3723 SECONDS")).cast("timestamp")
    return table(spark, sf_dir, "orders").select(M.stamp(at).alias("stamp"), steps.alias("steps")).distinct()


@query("SELECT p_brand, count(*) AS parts, false AS there FROM part GROUP BY 1")
def discarded_table(spark, sf_dir):
    """A temporary table is gone once it is discarded; discarding it again does nothing."""
    path = store.new_path(spark, "temporary")
    table(spark, sf_dir, "part").select("p_brand").write.parquet(path)
    counted = store.cut(spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("parts")))
    for _ in range(2):
        store.discard(spark, path)
    return counted.withColumn("there", F.lit(store.exists(spark, path)))


@query("SELECT 'SUCCEEDED' AS state, count(*) AS parts FROM part")
def job_states(spark, sf_dir):
    """M5: the states of an export's jobs, polled until none is running."""
    sc, group = spark.sparkContext, f"export-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "export")
    try:
        path = store.new_path(spark, "export")
        table(spark, sf_dir, "part").select("p_partkey").write.parquet(path)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    states = sorted(set(sinks.poll(spark, group).values()))
    return spark.read.parquet(path).agg(F.count("*").alias("parts")).select(F.lit(", ".join(states)).alias("state"), "parts")
