"""Features: masks from polygons, dissolving, layer areas."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import geometry as P
from ..functions import projections as J
from ..functions import stitching
from ..model import GEOMETRY, GridSpec
from . import grid as G
from .overlay import _column as shapes
from .overlay import repair

#: Insets of a map (fixed value).
SLOTS = 4
#: Envelopes that a strip of a key has on average when :func:`dissolve` looks for overlaps.
STRIP_PARTS = 4096


def mask_cells(features: DataFrame, grid: GridSpec, geometry: str = "geometry", bin_cells: int = 64, carry: str | None = None) -> DataFrame:
    """``row, col`` of the cells whose centre is in some polygon of ``features``; with ``carry`` also the largest value of that column among them.

    A polygon costs its edges' crossings with lines of cell centres and the cells inside, whatever its shape: see :func:`scan_lines`.  On rotated grids it meets
    the cells of the bins its envelope touches, through an equi-join on the bin, and each point is tested.
    """
    if grid.transform[1] or grid.transform[3]:
        return _mask_by_bins(features, grid, geometry, bin_cells, carry)
    keep = [F.col(carry).alias("_carried")] if carry else []
    polys = features.where(P.is_usable(F.col(geometry))).select(*keep, F.explode(F.col(geometry)["polys"]).alias("_rings"))
    spans = polys.select(*["_carried"] * bool(carry), F.explode(scan_lines(F.col("_rings"), grid)).alias("_s"))
    near = lambda x: F.floor(G.to_colrow(grid, x, F.lit(0.0))[0])
    ends = [near(F.col("_s")[k]) for k in ("a", "b")]
    lo, hi = F.greatest(F.least(*ends) - 1, F.lit(0)).cast("int"), F.least(F.greatest(*ends) + 1, F.lit(grid.width - 1)).cast("int")
    held = spans.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").select("*", F.explode(F.sequence("_lo", "_hi")).alias("col"))
    x, _ = G.centres(grid, F.col("col"), F.col("_s.row"))
    held = held.where((x >= F.col("_s.a")) & (x < F.col("_s.b"))).select(F.col("_s.row").alias("row"), "col", *["_carried"] * bool(carry))
    if carry:
        return held.groupBy("row", "col").agg(F.max("_carried").alias(carry))
    return held.distinct()


def scan_lines(rings: Column, grid: GridSpec) -> Column:
    """``array<struct<row,a,b>>``: where a polygon's inside begins and ends on the line of centres of each row, by the even-odd rule.

    An edge gives its crossings with those lines; in order of row and place they form pairs, as each line crosses closed rings an even number of times.
    A vertex on a line counts with its lower edge.
    """
    height = lambda r: G.centres(grid, F.lit(0), r)[1]
    place = lambda y: G.to_colrow(grid, F.lit(0.0), y)[1]

    def crossed(e: Column) -> Column:
        p, q = e["a"], e["b"]
        v = [place(p["y"]), place(q["y"])]
        lo, hi = F.greatest(F.floor(F.least(*v)) - 1, F.lit(0)), F.least(F.ceil(F.greatest(*v)) + 1, F.lit(grid.height - 1))
        rows = F.when((lo <= hi) & (p["y"] != q["y"]), F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
        rows = F.filter(rows, lambda r: (p["y"] > height(r)) != (q["y"] > height(r)))
        return F.transform(rows, lambda r: F.struct(r.alias("row"), (p["x"] + F.try_divide((height(r) - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])).alias("x")))

    at = F.sort_array(F.flatten(F.transform(F.flatten(F.transform(rings, P.edges)), crossed)))
    # The crossings are bound, so that pairing them does not compute them again.
    pairs = lambda c: F.filter(F.transform(c, lambda s, i: F.when(i % 2 == 0, F.struct(s["row"].alias("row"), s["x"].alias("a"), F.get(c, i + 1)["x"].alias("b")))), lambda s: s.isNotNull())
    return F.get(F.transform(F.array(at), pairs), F.lit(0))


def _mask_by_bins(features: DataFrame, grid: GridSpec, geometry: str, bin_cells: int, carry: str | None) -> DataFrame:
    spark = features.sparkSession
    f = features.where(P.is_usable(F.col(geometry))).select(*([F.col(carry).alias("_carried")] if carry else []), F.explode(F.col(geometry)["polys"]).alias("rings")).withColumn("b", P.bounds(F.array("rings")))
    corners = [G.to_colrow(grid, F.col("b")[x], F.col("b")[y]) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    clip = lambda v, n: F.greatest(F.least(F.floor(v), F.lit(n - 1)), F.lit(0))
    span = lambda i, n: F.sequence((clip(F.least(*[c[i] for c in corners]), n) / bin_cells).cast("int"), (clip(F.greatest(*[c[i] for c in corners]), n) / bin_cells).cast("int"))
    bins = f.withColumn("_bc", F.explode(span(0, grid.width))).withColumn("_br", F.explode(span(1, grid.height)))
    x, y = G.centres(grid, F.col("col"), F.col("row"))
    c = G.cells(spark, grid).select("row", "col", x.alias("x"), y.alias("y"), (F.col("col") / bin_cells).cast("int").alias("_bc"), (F.col("row") / bin_cells).cast("int").alias("_br"))
    inside = c.join(bins, ["_bc", "_br"]).where((F.col("x") >= F.col("b.xmin")) & (F.col("x") <= F.col("b.xmax")) & (F.col("y") >= F.col("b.ymin")) & (F.col("y") <= F.col("b.ymax")))
    held = inside.where(P.contains(F.array("rings"), F.col("x"), F.col("y")))
    if carry:
        return held.groupBy("row", "col").agg(F.max("_carried").alias(carry))
    return held.select("row", "col").distinct()


def apply_mask(cells: DataFrame, mask: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Cells inside the mask; with ``keep_rows`` the others stay with a NULL value."""
    if not keep_rows:
        return cells.join(mask, ["row", "col"], "left_semi")
    return cells.join(mask.withColumn("_in", F.lit(True)), ["row", "col"], "left").withColumn("value", F.when(F.col("_in"), F.col("value"))).drop("_in")


def clean_geometries(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Polygonal geometries only, made valid: see :func:`terracell.operators.overlay.repair`; the overlapping parts of a collection are united."""
    return repair(features.withColumn(geometry, P.force_polygonal(F.col(geometry))), geometry)


def gather_parts(features: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """One geometry per combination of ``keys``: all its parts side by side, each distinct part once.

    For layers that divide a territory, whose parts do not overlap; borders between touching parts stay.
    """
    parts = features.where(P.is_usable(F.col(geometry))).groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(geometry)["polys"])))).alias("polys"))
    kind = F.when(F.size("polys") == 1, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    return parts.select(*keys, F.struct(kind.alias("type"), F.col("polys").alias("polys")).alias(geometry))


def dissolve_coverage(features: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """One geometry per combination of ``keys`` from parts that do not overlap: borders that two parts share go, whatever their envelopes.

    Edges are directed so that the inside is on their left; an edge that stands in both directions is a shared border.  Edges are
    counted by Spark, and what is left of each key is stitched into rings by one task, see :func:`terracell.functions.stitching.polygons`.  A part that is there
    twice counts once.  Parts that overlap, or whose common border has other vertices on each side, keep those edges; the area is that of all parts.
    """
    polys = features.where(P.is_usable(F.col(geometry))).select(*keys, F.explode(F.col(geometry)["polys"]).alias("_rings")).distinct()
    rings = polys.select(*keys, F.posexplode("_rings").alias("_i", "_ring")).where(F.size("_ring") > 3)
    # A shell runs counterclockwise and a hole clockwise.
    turned = F.when((P.signed_area(F.col("_ring")) > 0) == (F.col("_i") == 0), F.col("_ring")).otherwise(F.reverse("_ring"))
    corners = rings.select(*keys, turned.alias("_ring")).select(*keys, "_ring", F.explode(F.sequence(F.lit(1), F.size("_ring") - 1)).alias("_i"))
    place = lambda i, k: F.get(F.col("_ring"), F.col("_i") + i)[k]
    edges = corners.select(*keys, place(-1, "x").alias("x0"), place(-1, "y").alias("y0"), place(0, "x").alias("x1"), place(0, "y").alias("y1"))
    a, b = F.struct("x0", "y0"), F.struct("x1", "y1")
    pick = lambda first, p, q: F.when(first, F.col(p)).otherwise(F.col(q)).alias(p)
    along = lambda first, n: [*keys, pick(first, "x0", "x1"), pick(first, "y0", "y1"), pick(first, "x1", "x0"), pick(first, "y1", "y0"), n.alias("n")]
    lone = edges.where(a != b).select(*along(a < b, F.when(a < b, 1).otherwise(-1))).groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.sum("n").alias("n"))
    left = lone.where("n <> 0").select(*along(F.col("n") > 0, F.abs("n")))

    def stitch(part: pa.Table) -> pa.Table:
        polys = stitching.polygons(*[np.repeat(part.column(k).to_numpy(), part.column("n").to_numpy()) for k in ("x0", "y0", "x1", "y1")])
        shape = shapes([polys]) if polys else pa.array([{"type": "MultiPolygon", "polys": []}], shapes([]).type)
        return part.select(keys).slice(0, 1).append_column(geometry, shape)

    return left.groupBy(*keys).applyInArrow(stitch, StructType([*(left.schema[k] for k in keys), StructField(geometry, GEOMETRY)]))


def dissolve(features: DataFrame, key: str, geometry: str = "geometry", strip_parts: int = STRIP_PARTS) -> DataFrame:
    """One multipolygon per key from disjoint parts; parts whose envelopes overlap raise, see :func:`dissolve_coverage` and :func:`terracell.operators.overlay.union`.

    Envelopes are dealt to strips of rows of their key, of ``strip_parts`` envelopes on average, and each strip is swept once: see :func:`overlapping`.
    A key has no more strips than leave its envelopes at about two strips each.
    """
    usable = features.where(P.is_usable(F.col(geometry))).select(F.struct(F.col(key)).alias("_g"), F.col(geometry)["polys"].alias("polys"))
    parts = usable.groupBy("_g").agg(F.flatten(F.collect_list("polys")).alias("polys"))
    boxes = usable.select("_g", F.explode("polys").alias("_p")).select("_g", P.bounds(F.array("_p")).alias("_b")).select("_g", "_b.*")
    boxes = boxes.where("xmin is not null and ymin is not null")
    tall, mean = F.max("ymax") - F.min("ymin"), F.sum(F.col("ymax") - F.col("ymin"))
    strips = boxes.groupBy("_g").agg(F.count("*").alias("n"), F.min("ymin").alias("_y0"), tall.alias("_tall"), mean.alias("_sum"))
    most = F.floor(F.least(F.col("n") / strip_parts, F.col("n") * F.try_divide(F.col("_tall"), F.col("_sum"))))
    count = F.when((F.col("_tall") > 0) & (F.col("_tall") < math.inf) & (most > 1), most).otherwise(F.lit(1).cast("long"))
    strips = strips.select("_g", "_y0", "_tall", count.alias("_count"))
    row = lambda y: F.when(F.col("_count") == 1, F.lit(0).cast("long")).otherwise(F.floor((F.col(y) - F.col("_y0")) / F.col("_tall") * F.col("_count")))
    dealt = boxes.join(strips, "_g").select("_g", F.explode(F.sequence(row("ymin"), row("ymax"))).alias("_row"), "xmin", "ymin", "xmax", "ymax")

    def sweep(t: pa.Table) -> pa.Table:
        return t.select(["_g"]).slice(0, int(overlapping(*[t.column(k).to_numpy() for k in ("xmin", "ymin", "xmax", "ymax")])))

    clashes = dealt.groupBy("_g", "_row").applyInArrow(sweep, StructType([usable.schema["_g"]])).distinct()
    joined = parts.join(clashes.withColumn("_clash", F.lit(True)), "_g", "left")
    kind = F.when(F.size("polys") == 1, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    shape = F.struct(kind.alias("type"), F.col("polys").alias("polys"))
    failed = F.raise_error(F.concat(F.lit("parts overlap for key "), F.col("_g")[key].cast("string"))).cast("struct<type:string,polys:array<array<array<struct<x:double,y:double>>>>>")
    return joined.select(F.col("_g")[key].alias(key), F.when(F.col("_clash"), failed).otherwise(shape).alias(geometry))


def overlapping(xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray) -> bool:
    """Do two of these boxes overlap; borders may touch.

    A line sweeps over x and holds the boxes it crosses, in order of y.  As long as none overlap, a new one can only meet its neighbours there.
    """
    # Ranks, as NaN is beyond all numbers.
    ranked = lambda low, high: np.split(np.unique(np.concatenate([low, high]), return_inverse=True)[1], 2)
    (x0, x1), (y0, y1) = ranked(xmin, xmax), ranked(ymin, ymax)
    boxes = list(zip(y0.tolist(), y1.tolist()))
    flat, wide = np.flatnonzero(x0 == x1), np.flatnonzero(x0 < x1)
    # Where several begin and end at one x, boxes end first; those without width meet what was there before, and are not held.
    box, kind = np.concatenate([wide, flat, wide]), np.repeat([0, 1, 2], [len(wide), len(flat), len(wide)])
    order = np.lexsort((kind, np.concatenate([x1[wide], x0[flat], x0[wide]])))
    held: list[tuple[int, int]] = []
    for k, b in zip(kind[order].tolist(), box[order].tolist()):
        low, high = boxes[b]
        i = bisect.bisect_left(held, (low, high))
        if k == 0:
            del held[i]
            continue
        if any(p < high and low < q for p, q in held[max(i - 1, 0) : i + 1]):
            return True
        if k == 2:
            held.insert(i, (low, high))
    return False


def total_bounds(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    b = features.where(P.is_usable(F.col(geometry))).select(P.bounds(F.col(geometry)["polys"]).alias("b"))
    return b.agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def layer_slots(features: DataFrame, layer: str, area: Column, slots: int = SLOTS) -> DataFrame:
    """``layer, area, slot``: layers by total area, the largest first; slots repeat beyond the last.  One row per layer is ranked."""
    total = features.groupBy(layer).agg(F.sum(area).alias("area"))
    rank = F.row_number().over(Window.orderBy(F.col("area").desc_nulls_last(), F.col(layer).asc()))
    return total.select(layer, "area", F.pmod(rank - 1, F.lit(slots)).cast("int").alias("slot"))


def crs_to_mollweide(features: DataFrame, geometry: str = "geometry", crs: str = "crs", projected: tuple[str, ...] = ()) -> DataFrame:
    """Geometries in metres: those in longitude and latitude, and those in the ``projected`` CRSs named (any that :func:`terracell.functions.projections.crs` knows); those with a Mollweide CRS, another or none stay."""
    from ..functions import mollweide as M
    from .reproject import lonlat, LONLAT

    named = F.upper(F.col(crs))
    moved = F.when(named.isin(*LONLAT), P.transform_points(F.col(geometry), M.forward))
    for code in projected:
        to, _ = lonlat(code)
        moved = moved.when(named == code.upper(), P.transform_points(F.col(geometry), lambda x, y, to=to: M.forward(*to(x, y))))
    known = named.isin(*LONLAT, *(c.upper() for c in projected))
    return features.withColumn(geometry, moved.otherwise(F.col(geometry))).withColumn(crs, F.when(known, F.lit(M.CODE)).otherwise(F.col(crs)))


def to_crs(features: DataFrame, target: str, sources: list[str], geometry: str = "geometry", crs: str = "crs") -> DataFrame:
    """Geometries of the CRSs in ``sources`` (codes, WKT or PROJ strings, as in column ``crs``) in the target's coordinates; others stay.

    Each corner is moved; points outside the target's projection become NULL.  One expression for each source, no shuffle.
    """
    named, moved = F.col(crs), None
    for s in sources:
        steps = J.between(s, target)
        here = P.transform_points(F.col(geometry), lambda x, y, steps=steps: J.on_columns(steps, x, y))
        moved = F.when(named == s, here) if moved is None else moved.when(named == s, here)
    if moved is None:
        return features
    return features.withColumn(geometry, moved.otherwise(F.col(geometry))).withColumn(crs, F.when(named.isin(*sources), F.lit(target)).otherwise(named))


def circle(cx: float, cy: float, r: float, n: int = 32) -> list:
    """A closed ring around a centre, for tests and buffers of points."""
    pts = [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*pts, pts[0]]
