from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..functions import mollweide as M
from ..functions import projections as J
from ..model import VAR_TYPES, GridSpec
from ..operators import grid as G
from ..operators import reproject as W
from ..operators import resample as R
from ..plans import align as A
from .base import query, r6, table

#: Parts as a raster 50 cells wide with cells of 1, counting rows upwards from 0; targets of 2.5 and 2.
WIDTH = 50


def _grid(spark, sf_dir) -> GridSpec:
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    return GridSpec("LOCAL", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), WIDTH, -(-n // WIDTH))


def _coarse(g: GridSpec, size: float) -> GridSpec:
    return GridSpec("LOCAL", (size, 0.0, 0.0, 0.0, size, 0.0), int(-(-g.width // size)), int(-(-g.height // size)))


def _cells(spark, sf_dir, value="p_retailprice"):
    p = table(spark, sf_dir, "part")
    # Every 13th cell is missing.
    v = F.when(F.col("p_partkey") % 13 != 0, F.col(value).cast("double"))
    return p.select((F.col("p_partkey") / WIDTH).cast("int").alias("row"), (F.col("p_partkey") % WIDTH).cast("int").alias("col"), v.alias("value"))


_SRC = "src AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CAST({v} AS DOUBLE) AS v FROM part WHERE p_partkey % 13 <> 0), top AS (SELECT max(p_partkey) // 50 + 1 AS h FROM part)"


def _overlap_sql(size: float, select: str, v: str = "p_retailprice", tail: str = "GROUP BY ALL") -> str:
    return f"""WITH {_SRC.format(v=v)}, o AS (
  SELECT CAST(tr AS INTEGER) AS row, CAST(tc AS INTEGER) AS col, v,
         (least(r + 1, (tr + 1) * {size}) - greatest(r, tr * {size})) * (least(c + 1, (tc + 1) * {size}) - greatest(c, tc * {size})) AS w
  FROM src, top, range(0, CAST(ceil(50 / {size}) AS BIGINT)) a(tc), range(0, 20000) b(tr)
  WHERE tr < ceil(h / {size}) AND tr * {size} < r + 1 AND (tr + 1) * {size} > r AND tc * {size} < c + 1 AND (tc + 1) * {size} > c
) {select} {tail}"""


def _regridded(how: str, size: float, v: str = "p_retailprice"):
    def run(spark, sf_dir):
        g = _grid(spark, sf_dir)
        out = R.regrid(_cells(spark, sf_dir, v), g, _coarse(g, size), how)
        return out.select("row", "col", r6("value", 4).alias("value"))

    run.__doc__ = f"R5, J4: resample {how} from 1 to {size}."
    return run


query(_overlap_sql(2.5, "SELECT row, col, round(sum(v * w) / sum(w), 4) AS value FROM o"), "regrid_average")(_regridded("average", 2.5))
query(_overlap_sql(2.5, "SELECT row, col, round(max(v), 4) AS value FROM o"), "regrid_max")(_regridded("max", 2.5))
query(_overlap_sql(2.5, "SELECT row, col, round(min(v), 4) AS value FROM o"), "regrid_min")(_regridded("min", 2.5))
query(_overlap_sql(2.0, "SELECT row, col, round(quantile_cont(v, 0.5), 4) AS value FROM o"), "regrid_median")(_regridded("med", 2.0))
query(_overlap_sql(2.0, "SELECT row, col, round(quantile_cont(v, 0.25), 4) AS value FROM o"), "regrid_q1")(_regridded("q1", 2.0))
query(_overlap_sql(2.0, "SELECT row, col, round(quantile_cont(v, 0.75), 4) AS value FROM o"), "regrid_q3")(_regridded("q3", 2.0))
for _how, _q in (("med", 0.5), ("q1", 0.25), ("q3", 0.75)):
    query(_overlap_sql(8.0, f"SELECT row, col, round(quantile_disc(v, {_q}), 4) AS value FROM o"), f"sketched_{_how}")(
        lambda spark, sf_dir, how=_how: R.regrid(_cells(spark, sf_dir), _grid(spark, sf_dir), _coarse(_grid(spark, sf_dir), 8.0), how, accuracy=10_000).select("row", "col", r6("value", 4).alias("value"))
    )
query(
    _overlap_sql(2.5, ", n AS (SELECT row, col, v, round(sum(w), 9) AS n FROM o GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, v) AS i FROM n) SELECT row, col, round(v, 4) AS value FROM k WHERE i = 1", "p_size % 5", ""),
    "regrid_mode",
)(lambda spark, sf_dir: R.regrid(_cells(spark, sf_dir, "p_size").withColumn("value", F.col("value") % 5), _grid(spark, sf_dir), _coarse(_grid(spark, sf_dir), 2.5), "mode").select("row", "col", r6("value", 4).alias("value")))


@query(_overlap_sql(2.5, "SELECT row, col, CAST(round(round_even(sum(v * w) / sum(w) * 6.25, 0), 0) AS BIGINT) AS value FROM o", "p_size"))
def regrid_counts(spark, sf_dir):
    """Mean of valid cells times the ratio of areas, half to even."""
    g = _grid(spark, sf_dir)
    return R.regrid_counts(_cells(spark, sf_dir, "p_size"), g, _coarse(g, 2.5), integer=True).select("row", "col", "value")


@query(_overlap_sql(2.5, "SELECT row, col, round(CAST(CAST(sum(v * w) AS FLOAT) AS DOUBLE), 3) AS value FROM o", "p_size"))
def regrid_counts_exact(spark, sf_dir):
    """R16 with conservation, A24a."""
    g = _grid(spark, sf_dir)
    return R.regrid_counts(_cells(spark, sf_dir, "p_size"), g, _coarse(g, 2.5), exact=True).select("row", "col", r6(F.col("value").cast("double"), 3).alias("value"))


@query(_overlap_sql(2.5, "SELECT row, col, round(sum(v * w) / sum(w), 4) AS mean, round(sum(v * w), 4) AS total FROM o"))
def reduced_cells(spark, sf_dir):
    """Reducers of the catalog flavour."""
    g = _grid(spark, sf_dir)
    c, d = _cells(spark, sf_dir), _coarse(g, 2.5)
    mean = R.reduce_cells(c, g, d, "mean").withColumnRenamed("value", "mean")
    total = R.reduce_cells(c, g, d, "sum").withColumnRenamed("value", "total")
    return mean.join(total, ["row", "col"]).select("row", "col", r6("mean", 4).alias("mean"), r6("total", 4).alias("total"))


_TARGET = "t AS (SELECT tr, tc, (tc + 0.5) * 1.5 AS x, (tr + 0.5) * 1.5 AS y FROM top, range(0, 34) a(tc), range(0, 20000) b(tr) WHERE tr < ceil(h / 1.5))"


@query(f"WITH {_SRC.format(v='p_retailprice')}, {_TARGET} SELECT CAST(tr AS INTEGER) AS row, CAST(tc AS INTEGER) AS col, round(v, 4) AS value FROM t JOIN src ON floor(x) = c AND floor(y) = r")
def regrid_nearest(spark, sf_dir):
    """The source cell around the target's centre."""
    g = _grid(spark, sf_dir)
    return R.regrid(_cells(spark, sf_dir), g, _coarse(g, 1.5), "nearest").select("row", "col", r6("value", 4).alias("value"))


@query(f"""WITH {_SRC.format(v='p_retailprice')}, {_TARGET}, n AS (
  SELECT tr, tc, v, greatest(1 - abs(x - 0.5 - c), 0) * greatest(1 - abs(y - 0.5 - r), 0) AS w FROM t, top JOIN src ON c BETWEEN floor(x - 0.5) AND floor(x - 0.5) + 1 AND r BETWEEN floor(y - 0.5) AND floor(y - 0.5) + 1
  WHERE x < 50 AND y < h
) SELECT CAST(tr AS INTEGER) AS row, CAST(tc AS INTEGER) AS col, round(sum(v * w) / sum(w), 4) AS value FROM n WHERE w <> 0 GROUP BY ALL""")
def regrid_bilinear(spark, sf_dir):
    """Four neighbours, weights of missing ones shared."""
    g = _grid(spark, sf_dir)
    return R.regrid(_cells(spark, sf_dir), g, _coarse(g, 1.5), "bilinear").select("row", "col", r6("value", 4).alias("value"))


_KEYS = "CASE WHEN abs({d}) <= 1 THEN 1.5 * abs({d}) ** 3 - 2.5 * abs({d}) ** 2 + 1 WHEN abs({d}) < 2 THEN -0.5 * abs({d}) ** 3 + 2.5 * abs({d}) ** 2 - 4 * abs({d}) + 2 ELSE 0 END"


@query(f"""WITH {_SRC.format(v='p_retailprice')}, {_TARGET}, n AS (
  SELECT tr, tc, v, ({_KEYS.format(d='(x - 0.5 - c)')}) * ({_KEYS.format(d='(y - 0.5 - r)')}) AS w FROM t, top JOIN src ON c BETWEEN floor(x - 0.5) - 1 AND floor(x - 0.5) + 2 AND r BETWEEN floor(y - 0.5) - 1 AND floor(y - 0.5) + 2
  WHERE x < 50 AND y < h
), s AS (SELECT tr, tc, sum(v * w) AS a, sum(w) AS b FROM n WHERE w <> 0 GROUP BY ALL)
SELECT CAST(tr AS INTEGER) AS row, CAST(tc AS INTEGER) AS col, round(a / b, 3) AS value FROM s WHERE abs(b) > 1e-9""")
def regrid_cubic(spark, sf_dir):
    """Sixteen neighbours."""
    g = _grid(spark, sf_dir)
    return R.regrid(_cells(spark, sf_dir), g, _coarse(g, 1.5), "cubic").select("row", "col", r6("value", 3).alias("value"))


@query(_overlap_sql(2.0, "SELECT row, col, round(sum(v * w) / sum(w), 4) AS value, 'A' AS moved FROM o"))
def align_two(spark, sf_dir):
    """The finer raster moves onto the coarser grid."""
    g = _grid(spark, sf_dir)
    d = _coarse(g, 2.0)
    other = G.cells(spark, d).withColumn("value", F.lit(1.0))
    out, label = A.align_two(_cells(spark, sf_dir), g, "continuous", other, d, "continuous")
    return out.select("row", "col", r6("value", 4).alias("value"), F.lit(label).alias("moved"))


@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'count' WHEN 1 THEN 'share' WHEN 2 THEN 'continuous' WHEN 3 THEN 'categorical' WHEN 4 THEN 'binary' ELSE 'other' END AS k, p_size AS s FROM part)
SELECT p_partkey, k AS var_type, CASE WHEN k = 'other' THEN NULL WHEN s = 25 THEN CASE WHEN k IN ('categorical', 'binary', 'count') THEN 'nearest' ELSE 'bilinear' END
WHEN s < 25 THEN CASE WHEN k IN ('categorical', 'binary') THEN 'mode' ELSE 'average' END ELSE CASE WHEN k IN ('categorical', 'binary') THEN 'nearest' ELSE 'bilinear' END END AS method,
CASE WHEN s < 25 THEN CASE k WHEN 'count' THEN 'sum' WHEN 'share' THEN 'mean' WHEN 'continuous' THEN 'mean' WHEN 'other' THEN NULL ELSE 'mode' END END AS reducer FROM v""")
def resampling_rules(spark, sf_dir):
    """R12, R14, R18, A24d: how each of many layers is resampled or reduced, by its variable type and cell size."""
    kinds = F.create_map(*[F.lit(x) for i, k in enumerate(VAR_TYPES) for x in (i, k)])
    k = F.coalesce(F.try_element_at(kinds, (F.col("p_partkey") % 6).cast("int")), F.lit("other"))
    p = table(spark, sf_dir, "part").select("p_partkey", k.alias("var_type"), F.col("p_size").cast("double").alias("size"))
    d = A.decisions(F.col("var_type"), F.col("size"), F.lit(25.0))
    return p.select("p_partkey", "var_type", d["method"].alias("method"), d["reducer"].alias("reducer"))


@query("SELECT p_partkey AS id, round(500.0 + 2.5 * (p_partkey % 50) + 0.5 * (p_partkey // 50), 6) AS x, round(900.0 - 3.0 * (p_partkey // 50) + 0.25 * (p_partkey % 50), 6) AS y, CAST(p_partkey % 50 AS DOUBLE) AS col, CAST(p_partkey // 50 AS DOUBLE) AS row FROM part")
def affine_round_trip(spark, sf_dir):
    """R2: cell corners of a sheared grid, and back."""
    g = GridSpec("LOCAL", (2.5, 0.5, 500.0, 0.25, -3.0, 900.0), WIDTH, 1)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % WIDTH).alias("c"), (F.col("p_partkey") / WIDTH).cast("long").alias("r"))
    x, y = G.to_xy(g, F.col("c"), F.col("r"))
    q = p.select("id", x.alias("x"), y.alias("y"))
    col, row = G.to_colrow(g, F.col("x"), F.col("y"))
    return q.select("id", r6("x").alias("x"), r6("y").alias("y"), r6(col).alias("col"), r6(row).alias("row"))


@query("""SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, 100.0 + 10 * c AS xmin, 200.0 - 10 * (r + 1) AS ymin, 100.0 + 10 * (c + 1) AS xmax, 200.0 - 10 * r AS ymax
FROM (SELECT unnest(range(0, max(p_partkey) // 50 + 1)) AS r FROM part), range(0, 50) b(c)""")
def cell_boxes(spark, sf_dir):
    """Boxes of all cells of the parts' raster."""
    g = GridSpec.square("LOCAL", 100.0, 200.0, 10.0, WIDTH, _grid(spark, sf_dir).height)
    return G.with_boxes(G.cells(spark, g), g)


@query("""WITH m AS (SELECT p_partkey, ['nearest', ' Bilinear', 'CUBIC ', 'average', 'Mode', 'max', 'min', 'med', 'Q1', ' q3 ', 'lanczos', '', NULL][p_partkey % 13 + 1] AS name FROM part)
SELECT p_partkey, CASE WHEN lower(trim(name)) IN ('nearest', 'bilinear', 'cubic', 'average', 'mode', 'max', 'min', 'med', 'q1', 'q3') THEN lower(trim(name)) END AS method FROM m""")
def resampling_names(spark, sf_dir):
    """Names of methods in any case, with blanks; unknown ones are NULL."""
    names = F.array(*[F.lit(n) for n in ("nearest", " Bilinear", "CUBIC ", "average", "Mode", "max", "min", "med", "Q1", " q3 ", "lanczos", "", None)])
    return table(spark, sf_dir, "part").select("p_partkey", R.method_names(F.get(names, (F.col("p_partkey") % 13).cast("int"))).alias("method"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey % 200 - 100) * 180000.0 AS x, (p_partkey // 200 % 100 - 50) * 180000.0 AS y FROM part),
s AS (SELECT *, y / (6378137.0 * sqrt(2.0)) AS s FROM p), t AS (SELECT *, CASE WHEN abs(s) <= 1 THEN asin(CASE WHEN abs(s) <= 1 THEN s END) END AS th FROM s),
l AS (SELECT id, degrees(pi() * x / (2 * sqrt(2.0) * 6378137.0 * cos(th))) AS lon, degrees(asin((2 * th + sin(2 * th)) / pi())) AS lat FROM t)
SELECT id, CASE WHEN abs(lon) <= 180 THEN round(lon, 6) + 0.0 END AS lon, CASE WHEN abs(lon) <= 180 THEN round(lat, 6) + 0.0 END AS lat FROM l""")
def mollweide_inverse(spark, sf_dir):
    """Metres to degrees, NULL outside the ellipse."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 200 - 100) * 180000.0).alias("x"), (((F.col("p_partkey") / 200).cast("long") % 100 - 50) * 180000.0).alias("y"))
    lon, lat = M.inverse(F.col("x"), F.col("y"))
    return p.select("id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("SELECT p_partkey AS id, CAST(p_partkey % 359 - 179 AS DOUBLE) AS lon, CAST(p_partkey % 179 - 89 AS DOUBLE) AS lat FROM part")
def mollweide_round_trip(spark, sf_dir):
    """Forward by Newton steps and back."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 359 - 179).cast("double").alias("lon"), (F.col("p_partkey") % 179 - 89).cast("double").alias("lat"))
    x, y = M.forward(F.col("lon"), F.col("lat"))
    q = p.select("id", x.alias("x"), y.alias("y"))
    lon, lat = M.inverse(F.col("x"), F.col("y"))
    return q.select("id", r6(lon, 5).alias("lon"), r6(lat, 5).alias("lat"))


@query("""WITH g AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, -1000000.0 + (c + 0.5) * 20000 AS x, 5000000.0 - (r + 0.5) * 20000 AS y FROM range(0, 60) a(r), range(0, 60) b(c)),
t AS (SELECT *, asin(y / (6378137.0 * sqrt(2.0))) AS th FROM g),
l AS (SELECT row, col, degrees(pi() * x / (2 * sqrt(2.0) * 6378137.0 * cos(th))) AS lon, degrees(asin((2 * th + sin(2 * th)) / pi())) AS lat FROM t),
i AS (SELECT row, col, CAST(floor((lon + 12.0) / 0.5) AS BIGINT) AS sc, CAST(floor((43.0 - lat) / 0.5) AS BIGINT) AS sr FROM l)
SELECT row, col, p_retailprice AS value FROM i JOIN part ON p_partkey = sr * 50 + sc WHERE sc BETWEEN 0 AND 49 AND sr BETWEEN 0 AND 39""")
def warp_nearest(spark, sf_dir):
    """A lon/lat raster on a metric grid."""
    # The target is a window: it reads rows 2 to 23 of the source, however high that is.
    src = GridSpec.square("EPSG:4326", -12.0, 43.0, 0.5, WIDTH, _grid(spark, sf_dir).height)
    out, _ = W.to_mollweide(_prices(spark, sf_dir), src, how="nearest", target=GridSpec.square(M.CODE, -1000000.0, 5000000.0, 20000.0, 60, 60))
    return out.select("row", "col", "value")


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") / WIDTH).cast("int").alias("row"), (F.col("p_partkey") % WIDTH).cast("int").alias("col"), F.col("p_retailprice").alias("value"))


@query("""WITH RECURSIVE h AS (SELECT max(p_partkey) // 50 + 1 AS h FROM part), g AS (SELECT h, least(0.5, 20.0 / h) AS size FROM h),
n AS (SELECT 0 AS i, lat, radians(lat) AS th FROM (SELECT unnest([43.0, 43.0 - size * h]) AS lat FROM g)
  UNION ALL SELECT i + 1, lat, th - (2 * th + sin(2 * th) - pi() * sin(radians(lat))) / (2 + 2 * cos(2 * th)) FROM n WHERE i < 15),
e AS (SELECT lon * cos(th) * 2 * sqrt(2.0) * 6378137.0 / 180 AS x, sin(th) * sqrt(2.0) * 6378137.0 AS y FROM n, (SELECT unnest([-12.0, -12.0 + 50 * size]) AS lon FROM g) WHERE i = 15),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM e),
r AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / sqrt(2500.0 + h * h) AS res FROM b, h),
d AS (SELECT *, floor(x0 / res) * res AS l, ceil(y1 / res) * res AS t FROM r),
c AS (SELECT CAST(tr AS INTEGER) AS row, CAST(tc AS INTEGER) AS col, l + (tc + 0.5) * res AS x, t - (tr + 0.5) * res AS y
  FROM (SELECT *, unnest(range(0, CAST(ceil((t - y0) / res) AS BIGINT))) AS tr FROM d) u, LATERAL (SELECT unnest(range(0, CAST(ceil((u.x1 - u.l) / u.res) AS BIGINT))) AS tc)),
a AS (SELECT *, asin(y / (6378137.0 * sqrt(2.0))) AS th FROM c),
l AS (SELECT row, col, degrees(pi() * x / (2 * sqrt(2.0) * 6378137.0 * cos(th))) AS lon, degrees(asin((2 * th + sin(2 * th)) / pi())) AS lat FROM a),
i AS (SELECT row, col, CAST(floor((lon + 12.0) / size) AS BIGINT) AS sc, CAST(floor((43.0 - lat) / size) AS BIGINT) AS sr FROM l, g)
SELECT row, col, p_retailprice AS value FROM i JOIN part ON p_partkey = sr * 50 + sc WHERE sc BETWEEN 0 AND 49 AND sr >= 0""")
def warp_covering(spark, sf_dir):
    """The whole raster, at most 20 degrees high, on a metric grid around its outline."""
    h = _grid(spark, sf_dir).height
    out, _ = W.to_mollweide(_prices(spark, sf_dir), GridSpec.square("EPSG:4326", -12.0, 43.0, min(0.5, 20.0 / h), WIDTH, h), how="nearest")
    return out.select("row", "col", "value")


def _degrees(spark, sf_dir):
    """The raster of prices from 43 degrees north, at most 20 degrees high."""
    h = _grid(spark, sf_dir).height
    return GridSpec.square("EPSG:4326", -12.0, 43.0, min(0.5, 20.0 / h), WIDTH, h)


@query("SELECT crs, round(sum(p_retailprice), 2) AS total FROM part, (VALUES ('ESRI:54009'), ('EPSG:3035'), ('EPSG:32629')) AS t(crs) GROUP BY 1")
def warped_totals(spark, sf_dir):
    """Counts on grids of other CRSs by shares of area; totals are what they were."""
    src, cells, out = _degrees(spark, sf_dir), _prices(spark, sf_dir), None
    targets = [GridSpec.square(M.CODE, -1_500_000.0, 5_500_000.0, 125_000.0, 40, 30), GridSpec.square("EPSG:3035", 1_500_000.0, 3_200_000.0, 125_000.0, 40, 30), GridSpec.square("EPSG:32629", -500_000.0, 5_300_000.0, 125_000.0, 40, 30)]
    for t in targets:
        one = R.reduce_cells(cells, src, t, "sum").agg(F.round(F.sum("value"), 2).alias("total")).select(F.lit(t.crs).alias("crs"), "total")
        out = one if out is None else out.unionByName(one)
    return out


_SINUSOID = "+proj=sinu +R=6371007.181 +units=m"


@query("""WITH g AS (SELECT max(p_partkey) // 50 + 1 AS h FROM part), p AS (SELECT p_partkey AS id, p_partkey % 50 AS c, p_partkey // 50 AS r, p_retailprice AS v, least(0.5, 20.0 / h) AS d FROM part, g),
m AS (SELECT p.id, p.v, i, -12.0 + (c + CASE WHEN i IN (1, 2) THEN 1 ELSE 0 END) * d AS lon, 43.0 - (r + CASE WHEN i IN (2, 3) THEN 1 ELSE 0 END) * d AS lat FROM p, range(0, 4) AS t(i)),
q AS (SELECT id, v, i, (6371007.181 * radians(lon) * cos(radians(lat)) + 1200000.0) / 90000.0 AS x, (4900000.0 - 6371007.181 * radians(lat)) / 90000.0 AS y FROM m),
b AS (SELECT id, v, floor(min(x)) AS x0, ceil(max(x)) AS x1, floor(min(y)) AS y0, ceil(max(y)) AS y1 FROM q GROUP BY 1, 2),
t AS (SELECT id, v, col, unnest(range(CAST(greatest(y0, 0) AS BIGINT), CAST(least(y1, 40) AS BIGINT))) AS row FROM (SELECT *, unnest(range(CAST(greatest(x0, 0) AS BIGINT), CAST(least(x1, 60) AS BIGINT))) AS col FROM b)),
e AS (SELECT a.id, a.x AS xa, a.y AS ya, z.x AS xb, z.y AS yb FROM q a JOIN q z ON a.id = z.id AND z.i = (a.i + 1) % 4),
s AS (SELECT t.id, t.v, t.row, t.col, xa, ya, xb, yb, least(greatest(ya, row), row + 1) AS p, least(greatest(yb, row), row + 1) AS n FROM t JOIN e ON t.id = e.id),
w AS (SELECT *, xa + (p - ya) / (yb - ya) * (xb - xa) - col AS l, xa + (n - ya) / (yb - ya) * (xb - xa) - col AS u FROM s WHERE p <> n),
f AS (SELECT *, CASE WHEN l <= 0 THEN 0 WHEN l >= 1 THEN l - 0.5 ELSE l * l / 2 END AS fl, CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN u - 0.5 ELSE u * u / 2 END AS fu FROM w),
o AS (SELECT id, v, row, col, abs(sum((n - p) * CASE WHEN abs(u - l) < 1e-7 THEN least(greatest((u + l) / 2, 0), 1) ELSE (fu - fl) / (u - l) END)) AS area FROM f GROUP BY ALL)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(sum(v * area) / sum(area), 3) AS value, round(sum(area), 5) AS covered FROM o WHERE area > 1e-6 GROUP BY 1, 2""")
def warped_average(spark, sf_dir):
    """Area-weighted average on a grid of another CRS, and how much of each cell is covered."""
    o = R.overlaps(_prices(spark, sf_dir), _degrees(spark, sf_dir), GridSpec.square(_SINUSOID, -1_200_000.0, 4_900_000.0, 90_000.0, 60, 40), []).where("area > 1e-6")
    a = o.groupBy("row", "col").agg((F.sum(F.col("value") * F.col("area")) / F.sum("area")).alias("value"), F.sum("area").alias("covered"))
    return a.select("row", "col", r6("value", 3).alias("value"), r6("covered", 5).alias("covered"))


@query("""WITH p AS (SELECT p_partkey AS id, radians(p_partkey % 80 - 30.0) AS lon, radians(p_partkey // 80 % 50 + 20.0) AS lat FROM part), k AS (SELECT 6378137.0 AS a, sqrt(2 / 298.257222101 - 1 / 298.257222101 ** 2) AS e),
u AS (SELECT *, sin(lat) AS s, sin(radians(52.0)) AS s0 FROM p, k), v AS (SELECT *, (1 - e * e) * (s / (1 - e * e * s * s) + atanh(e * s) / e) AS q, (1 - e * e) * (s0 / (1 - e * e * s0 * s0) + atanh(e * s0) / e) AS q0, (1 - e * e) * (1 / (1 - e * e) + atanh(e) / e) AS qp FROM u),
w AS (SELECT *, asin(q / qp) AS b, asin(q0 / qp) AS b0, sqrt(qp / 2) AS r, cos(radians(52.0)) / sqrt(1 - e * e * s0 * s0) AS m, lon - radians(10.0) AS d FROM v),
x AS (SELECT *, m / (r * cos(b0)) AS k, r * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(d))) AS f FROM w)
SELECT id, round(4321000.0 + a * f * k * cos(b) * sin(d), 3) AS x, round(3210000.0 + a * f / k * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(d)), 3) AS y, round(degrees(lon), 8) + 0.0 AS lon, round(degrees(lat), 8) + 0.0 AS lat FROM x""")
def equal_area_points(spark, sf_dir):
    """An ellipsoidal azimuthal projection, and back."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), (k % 80 - 30.0).alias("x"), (F.floor(k / 80) % 50 + 20.0).alias("y"))
    there = J.on_frame(p, J.between("EPSG:4326", "EPSG:3035"), [("x", "y")])
    back = J.on_frame(there.select("*", F.col("x").alias("lon"), F.col("y").alias("lat")), J.between("EPSG:3035", "EPSG:4326"), [("lon", "lat")])
    return back.select("id", r6("x", 3).alias("x"), r6("y", 3).alias("y"), r6("lon", 8).alias("lon"), r6("lat", 8).alias("lat"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN -3.0 WHEN 2 THEN -2.0 WHEN 3 THEN -1.5 WHEN 4 THEN -9999.0 WHEN 5 THEN CAST('nan' AS DOUBLE) WHEN 6 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS v, l_linenumber % 2 + 1 AS band FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN band <> 1 THEN CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE round(v, 5) END WHEN isnan(v) OR isinf(v) OR v = -9999 OR v + 2 <= 0 THEN NULL ELSE round(ln(CASE WHEN v > -2 AND NOT isinf(v) THEN v + 2 END), 5) + 0.0 END AS value FROM v""")
def night_lights(spark, sf_dir):
    """Logarithm of band 1 where it is defined."""
    n = F.col("l_linenumber")
    v = F.when(n == 1, -3.0).when(n == 2, -2.0).when(n == 3, -1.5).when(n == 4, -9999.0).when(n == 5, float("nan")).when(n == 6, float("inf")).otherwise(F.col("l_quantity"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), (n % 2 + 1).alias("band"))
    done = clean.on_band(F.col("band"), 1, clean.lights_log(F.col("v")), F.when(clean.finite(F.col("v")), F.col("v")))
    return d.select("l_orderkey", "l_linenumber", r6(done, 5).alias("value"))


@query("SELECT p_partkey, round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 3) AS f, CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS half, round(p_retailprice - 273.15, 4) AS c FROM part")
def scalar_math(spark, sf_dir):
    """Celsius, 32-bit floats, half to even."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice").cast("float").cast("double"), 3).alias("f"), clean.rint_long(F.col("p_size") / 2.0).alias("half"), F.round(clean.celsius(F.col("p_retailprice")), 4).alias("c"))


_PAIR = "c AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size % 4 AS v FROM part WHERE p_partkey % 13 <> 0)"


def _classes(spark, sf_dir):
    return _cells(spark, sf_dir, "p_size").where("value is not null").withColumn("value", F.col("value") % 4)


@query(f"WITH {_PAIR} SELECT CAST(r // 2 AS INTEGER) AS row, CAST(c // 2 AS INTEGER) AS col, round(avg(v), 6) AS value FROM c GROUP BY ALL")
def pyramid_mean(spark, sf_dir):
    """Overview by mean."""
    return G.pyramid(_classes(spark, sf_dir), [], "mean").select("row", "col", r6("value").alias("value"))


@query(f"WITH {_PAIR}, n AS (SELECT r // 2 AS r, c // 2 AS c, v, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, v) AS i FROM n) SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(v AS DOUBLE) AS value FROM k WHERE i = 1")
def pyramid_mode(spark, sf_dir):
    """Overview by mode, ties to the smallest."""
    return G.pyramid(_classes(spark, sf_dir), [], "mode").select("row", "col", "value")


@query(f"WITH {_PAIR} SELECT CAST(r // 2 AS INTEGER) AS row, CAST(c // 2 AS INTEGER) AS col, CAST(arg_min(v, (r, c)) AS DOUBLE) AS value FROM c GROUP BY ALL")
def pyramid_sample(spark, sf_dir):
    """Overview by its first cell."""
    return G.pyramid(_classes(spark, sf_dir), [], "sample").select("row", "col", "value")


@query("SELECT label, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col, round(avg(CAST(embedding[i] AS DOUBLE)), 5) + 0.0 AS value FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def tile_cells(spark, sf_dir):
    """Arrays as 8 x 8 tiles, to cells, to a mean tile."""
    c = G.tiles_to_cells(table(spark, sf_dir, "embeddings"), "embedding", 8, ["label"])
    return c.groupBy("label", "row", "col").agg(r6(F.avg("value"), 5).alias("value"))


@query("SELECT label, row, col, round(v, 5) + 0.0 AS value FROM (SELECT label, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col, max(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) r(i) GROUP BY ALL)")
def tile_round_trip(spark, sf_dir):
    """Cells to tiles and back."""
    c = G.tiles_to_cells(table(spark, sf_dir, "embeddings"), "embedding", 8, ["label"]).groupBy("label", "row", "col").agg(F.max("value").alias("value"))
    back = G.tiles_to_cells(G.cells_to_tiles(c, 8, 8, ["label"]), "tile", 8, ["label"])
    return back.select("label", "row", "col", r6("value", 5).alias("value"))
