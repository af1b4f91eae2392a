from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as P
from ..model import GridSpec
from ..operators import overlay as O
from ..operators import vector as V
from ..plans import picture
from ..sources import geojson
from .base import query, r6, table

_EMPTY = "array<array<array<struct<x:double,y:double>>>>"


def _rectangles(spark, sf_dir):
    """A rectangle per supplier: lower left corner and sides from its key and balance."""
    s = table(spark, sf_dir, "supplier")
    k, w = F.col("s_suppkey"), (F.col("s_suppkey") % 7 + 1).cast("double")
    x, y = (k % 10 * 20).cast("double"), ((k / 10).cast("long") * 20).cast("double")
    return s.select("s_suppkey", F.col("s_nationkey").alias("layer"), x.alias("x"), y.alias("y"), w.alias("w"), (w * 2).alias("h"), F.struct(F.lit("Polygon").alias("type"), P.rectangle(x, y, x + w, y + w * 2).alias("polys")).alias("geometry"))


_RECT = "r AS (SELECT s_suppkey, s_nationkey AS layer, CAST(s_suppkey % 10 * 20 AS DOUBLE) AS x, CAST(s_suppkey // 10 * 20 AS DOUBLE) AS y, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS w FROM supplier)"


@query(f"WITH {_RECT} SELECT s_suppkey, w * 2 * w AS area, w AS width, 2 * w AS height, 6 * w AS perimeter FROM r")
def envelope_metrics(spark, sf_dir):
    """Shoelace area and envelope metrics."""
    e = P.envelope_metrics(F.col("geometry.polys"))
    return _rectangles(spark, sf_dir).select("s_suppkey", P.area(F.col("geometry.polys")).alias("area"), e["width"].alias("width"), e["height"].alias("height"), e["perimeter"].alias("perimeter"))


@query(f"WITH {_RECT} SELECT min(x) AS xmin, min(y) AS ymin, max(x + w) AS xmax, max(y + 2 * w) AS ymax FROM r")
def total_bounds(spark, sf_dir):
    """Bounds of all features."""
    return V.total_bounds(_rectangles(spark, sf_dir))


@query(f"WITH {_RECT} SELECT s_suppkey, x - w * 0.05 AS xmin, y - 2 * w * 0.05 AS ymin, x + w + w * 0.05 AS xmax, y + 2 * w + 2 * w * 0.05 AS ymax FROM r")
def padded_bounds(spark, sf_dir):
    """Envelope with a margin."""
    b = P.padded_bounds(P.bounds(F.col("geometry.polys")))
    return _rectangles(spark, sf_dir).select("s_suppkey", *[b[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH {_RECT}, a AS (SELECT layer, sum(w * 2 * w) AS area FROM r GROUP BY 1) SELECT layer, area, CAST((row_number() OVER (ORDER BY area DESC, layer) - 1) % 4 AS INTEGER) AS slot FROM a")
def layer_slots(spark, sf_dir):
    """Layers by area in four slots."""
    return V.layer_slots(_rectangles(spark, sf_dir), "layer", P.area(F.col("geometry.polys")))


@query(f"""WITH {_RECT}, a AS (SELECT *, unnest(range(CAST(x // 2.5 AS BIGINT), CAST((x + w) // 2.5 AS BIGINT) + 1)) AS c FROM r),
b AS (SELECT *, unnest(range(CAST(y // 2.5 AS BIGINT), CAST((y + 2 * w) // 2.5 AS BIGINT) + 1)) AS r FROM a)
SELECT DISTINCT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM b WHERE c * 2.5 + 1.25 >= x AND c * 2.5 + 1.25 < x + w AND r * 2.5 + 1.25 >= y AND r * 2.5 + 1.25 < y + 2 * w
AND NOT (c * 2.5 + 1.25 >= x + w / 4 AND c * 2.5 + 1.25 < x + w * 3 / 4 AND r * 2.5 + 1.25 >= y + w / 2 AND r * 2.5 + 1.25 < y + w * 3 / 2)""")
def mask_cells(spark, sf_dir):
    """Cell centres in polygons with holes."""
    r = _rectangles(spark, sf_dir)
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    hole = P.rectangle(x + w / 4, y + w / 2, x + w * 3 / 4, y + w * 3 / 2)
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(F.col("geometry.polys")[0], hole[0])).alias("polys"))
    f = r.select(shape.alias("geometry"))
    # Cells count from the origin; the grid reaches as far as the features do.
    b = V.total_bounds(f).first()
    return V.mask_cells(f, GridSpec("LOCAL", (2.5, 0.0, 0.0, 0.0, 2.5, 0.0), *[max(1, math.ceil((v or 0) / 2.5)) for v in (b["xmax"], b["ymax"])]))


@query(f"""WITH {_RECT}, q AS (SELECT quantile_cont(w, [0.2, 0.4, 0.6, 0.8]) AS b FROM r),
c AS (SELECT *, unnest(range(CAST(x // 2.5 AS BIGINT), CAST((x + w) // 2.5 AS BIGINT) + 1)) AS col FROM r),
p AS (SELECT *, unnest(range(CAST(y // 2.5 AS BIGINT), CAST((y + 2 * w) // 2.5 AS BIGINT) + 1)) AS row FROM c)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST((w > b[1])::INT + (w > b[2])::INT + (w > b[3])::INT + (w > b[4])::INT AS INTEGER) AS class FROM p, q
WHERE col * 2.5 + 1.25 BETWEEN x AND x + w AND row * 2.5 + 1.25 BETWEEN y AND y + 2 * w""")
def choropleth_classes(spark, sf_dir):
    """The colour class of every pixel of a map, by quintile of the features' values."""
    r = _rectangles(spark, sf_dir)
    b = V.total_bounds(r).first()
    return picture.classes(r, "w", GridSpec("LOCAL", (2.5, 0.0, 0.0, 0.0, 2.5, 0.0), *[max(1, math.ceil((v or 0) / 2.5)) for v in (b["xmax"], b["ymax"])]))


@query(f"""WITH {_RECT}, b AS (SELECT layer, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + 2 * w) AS y1, sum(2 * w * w) AS area FROM r GROUP BY 1),
k AS (SELECT *, CASE WHEN layer <> 0 THEN (row_number() OVER (PARTITION BY layer = 0 ORDER BY area DESC, layer) - 1) % 4 END AS slot FROM b), n AS (SELECT max(slot) + 1 AS n FROM k),
h AS (SELECT *, (0.82 - (n - 1) * 0.02) / n AS h FROM k, n),
s AS (SELECT layer, slot, 2000 * CASE WHEN slot IS NULL THEN 0.33 ELSE 0.05 END AS px, 2000 * CASE WHEN slot IS NULL THEN 0.05 ELSE 0.08 + slot * (h + 0.02) END AS py, 2000 * CASE WHEN slot IS NULL THEN 0.64 ELSE 0.25 END AS pw,
  2000 * CASE WHEN slot IS NULL THEN 0.9 ELSE h END AS ph, x0 - m * (x1 - x0) AS x0, x1 + m * (x1 - x0) AS x1, y0 - m * (y1 - y0) AS y0, y1 + m * (y1 - y0) AS y1 FROM (SELECT *, CASE WHEN slot IS NULL THEN 0 ELSE 0.05 END AS m FROM h)),
g AS (SELECT *, greatest((x1 - x0) / pw, (y1 - y0) / ph) AS scale FROM s)
SELECT layer, CAST(slot AS INTEGER) AS slot, round(px, 6) AS px, round(py, 6) AS py, round(scale, 9) AS scale, round((x0 + x1) / 2 - (px + pw / 2) * scale, 6) + 0.0 AS "left", round((y0 + y1) / 2 + (py + ph / 2) * scale, 6) + 0.0 AS top FROM g""")
def inset_frames(spark, sf_dir):
    """M6, O3: places and scales of a mainland and of its islands, ranked by area, in one picture."""
    f = picture.inset_frames(_rectangles(spark, sf_dir), 0)
    return f.select("layer", "slot", r6("x").alias("px"), r6("y").alias("py"), r6("scale", 9).alias("scale"), r6("left").alias("left"), r6("top").alias("top"))


@query(f"WITH {_RECT} SELECT layer, count(*) AS parts, sum(w * 2 * w) AS area, CASE WHEN count(*) = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS type FROM r GROUP BY 1")
def dissolve(spark, sf_dir):
    """Disjoint parts of a key as one multipolygon."""
    d = V.dissolve(_rectangles(spark, sf_dir), "layer")
    return d.select("layer", F.size("geometry.polys").cast("long").alias("parts"), P.area(F.col("geometry.polys")).alias("area"), F.col("geometry.type").alias("type"))


@query("""WITH c AS (SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, p_partkey % 50 // 10 AS strip FROM part WHERE p_partkey % 23 <> 0),
n AS (SELECT c.*, (SELECT count(*) FROM c d WHERE d.strip = c.strip AND abs(d.x - c.x) + abs(d.y - c.y) = 1 AND d.y BETWEEN c.y - 1 AND c.y + 1) AS k FROM c)
SELECT CAST(strip AS BIGINT) AS strip, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - k) AS BIGINT) AS edges FROM n GROUP BY 1""")
def dissolved_coverage(spark, sf_dir):
    """Unit squares of a strip become one geometry without inner borders, with holes where a square is missing."""
    k = F.col("p_partkey")
    x, y = (k % 50).cast("double"), F.floor(k / 50).cast("double")
    shape = F.struct(F.lit("Polygon").alias("type"), P.rectangle(x, y, x + 1, y + 1).alias("polys"))
    squares = table(spark, sf_dir, "part").where(k % 23 != 0).select(F.floor(k % 50 / 10).alias("strip"), shape.alias("geometry"))
    d = V.dissolve_coverage(squares, ["strip"])
    polys = F.col("geometry.polys")
    return d.select("strip", P.area(polys).alias("area"), (F.size(P.points(polys)) - F.size(F.flatten(polys))).cast("long").alias("edges"))


@query(f"""WITH {_RECT} SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS type, CASE s_suppkey % 4 WHEN 0 THEN 2 * w * w ELSE 2 * w * w + 1 END AS area FROM r WHERE s_suppkey % 4 < 3""")
def clean_geometries(spark, sf_dir):
    """Collections keep polygons, other kinds and empty ones go."""
    r = _rectangles(spark, sf_dir)
    k = F.col("s_suppkey") % 4
    extra = P.rectangle(F.lit(-5.0), F.lit(-5.0), F.lit(-4.0), F.lit(-4.0))
    flat = P.rectangle(F.lit(-9.0), F.lit(-9.0), F.lit(-9.0), F.lit(-8.0))
    kind = F.when(k == 0, "Polygon").when(k == 1, "MultiPolygon").when(k == 2, "GeometryCollection").otherwise("Point")
    polys = F.when(k == 0, F.col("geometry.polys")).when(k < 3, F.concat(F.col("geometry.polys"), extra, flat)).otherwise(F.expr(f"cast(array() as {_EMPTY})"))
    c = V.clean_geometries(r.select("s_suppkey", F.struct(kind.alias("type"), polys.alias("polys")).alias("geometry")))
    return c.select("s_suppkey", F.col("geometry.type").alias("type"), P.area(F.col("geometry.polys")).alias("area"))


_TILES = """t AS (SELECT p_partkey % 9 AS k, CAST(p_partkey * 7 % 60 AS BIGINT) AS x, CAST(p_partkey * 13 % 41 AS BIGINT) AS y, p_size % 9 + 1 AS w, p_partkey % 5 + 1 AS h FROM part),
c AS (SELECT DISTINCT k, unnest(range(x, x + w)) AS x, y, h FROM t), d AS (SELECT DISTINCT k, x, unnest(range(y, y + h)) AS y FROM c)"""


@query(f"""WITH {_TILES}, e AS (SELECT d.k, d.x, d.y, s.dx, s.dy FROM d, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS s(dx, dy)),
o AS (SELECT e.k, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.k = e.k AND d.x = e.x + e.dx AND d.y = e.y + e.dy) GROUP BY 1)
SELECT CAST(d.k AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS area, CAST(any_value(o.n) AS DOUBLE) AS perimeter FROM d JOIN o ON d.k = o.k GROUP BY 1""")
def united_overlaps(spark, sf_dir):
    """Rectangles of a key that overlap in any way, united; area and length of the border."""
    k = F.col("p_partkey")
    x, y, w, h = (k * 7 % 60).cast("double"), (k * 13 % 41).cast("double"), F.col("p_size") % 9 + 1, k % 5 + 1
    shape = F.struct(F.lit("Polygon").alias("type"), P.rectangle(x, y, x + w, y + h).alias("polys"))
    u = O.union(table(spark, sf_dir, "part").select((k % 9).alias("k"), shape.alias("geometry")), ["k"])
    sides = F.flatten(F.transform(F.flatten("geometry.polys"), P.edges))
    length = F.aggregate(F.transform(sides, lambda e: F.abs(e["a"]["x"] - e["b"]["x"]) + F.abs(e["a"]["y"] - e["b"]["y"])), F.lit(0.0), lambda a, v: a + v)
    return u.select("k", P.area(F.col("geometry.polys")).alias("area"), length.alias("perimeter"))


@query(f"WITH {_RECT} SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 2 ELSE 1 END AS parts, CASE s_suppkey % 4 WHEN 0 THEN 1.5 * w * w WHEN 3 THEN 3.5 * w * w ELSE 2 * w * w END AS area FROM r")
def repaired_geometries(spark, sf_dir):
    """Holes that touch the shell, bow-ties, spikes, and collections with parts that overlap."""
    r = _rectangles(spark, sf_dir)
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    ring = lambda *pts: F.array(*[F.struct((x + a * w).alias("x"), (y + b * w).alias("y")) for a, b in pts])
    box = ((0, 0), (1, 0), (1, 2), (0, 2), (0, 0))
    shapes = [
        F.array(F.array(ring(*box), ring((0.25, 1), (0.75, 1), (0.75, 2), (0.25, 2), (0.25, 1)))),
        F.array(F.array(ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)))),
        F.array(F.array(ring((0, 0), (1, 0), (1, 2), (1, 5), (1, 2), (0, 2), (0, 0)))),
        F.array(F.array(ring(*box)), F.array(ring((0.5, 1), (1.5, 1), (1.5, 3), (0.5, 3), (0.5, 1)))),
    ]
    k = F.col("s_suppkey") % 4
    pick = F.when(k == 0, shapes[0]).when(k == 1, shapes[1]).when(k == 2, shapes[2]).otherwise(shapes[3])
    shape = F.struct(F.when(k == 3, "GeometryCollection").otherwise("Polygon").alias("type"), pick.alias("polys"))
    c = V.clean_geometries(r.select("s_suppkey", shape.alias("geometry")))
    return c.select("s_suppkey", F.size("geometry.polys").alias("parts"), P.area(F.col("geometry.polys")).alias("area"))


@query(f"WITH {_RECT} SELECT s_suppkey, 'Polygon' AS type, x AS xmin, y + 2 * w AS ymax, w * 2 * w AS area FROM r")
def geojson_round_trip(spark, sf_dir):
    """Geometries to GeoJSON text and back."""
    r = _rectangles(spark, sf_dir).select("s_suppkey", geojson.parse_geometry(P.to_geojson(F.col("geometry"))).alias("g"))
    b = P.bounds(F.col("g.polys"))
    return r.select("s_suppkey", F.col("g.type").alias("type"), b["xmin"].alias("xmin"), b["ymax"].alias("ymax"), P.area(F.col("g.polys")).alias("area"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ESRI:54009' END AS crs, round(CAST(s_suppkey % 90 AS DOUBLE), 4) AS lon FROM supplier")
def reprojected_features(spark, sf_dir):
    """lon/lat geometries in metres; layers without a CRS stay."""
    from ..functions import mollweide as M

    s = table(spark, sf_dir, "supplier")
    lon = (F.col("s_suppkey") % 90).cast("double")
    shape = F.struct(F.lit("Polygon").alias("type"), P.rectangle(lon, F.lit(10.0), lon + 1, F.lit(11.0)).alias("polys"))
    f = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "EPSG:4326").alias("crs"), shape.alias("geometry"))
    p = F.col("geometry.polys")[0][0][0]
    back = F.when(F.col("crs").isNotNull(), M.inverse(p["x"], p["y"])[0]).otherwise(p["x"])
    return V.crs_to_mollweide(f).select("s_suppkey", "crs", r6(back, 4).alias("lon"))
