"""Polygons as nested arrays of points: area, envelope, containment, cleaning - expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_POLYS = "array<array<array<struct<x:double,y:double>>>>"


def _pairs(ring: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` over consecutive points of a closed ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), f)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    """Area inside a closed ring, without sign."""
    return F.abs(_total(_pairs(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))) / 2


def signed_area(ring: Column) -> Column:
    """Area inside a closed ring, positive if it runs counterclockwise."""
    return _total(_pairs(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def edges(ring: Column) -> Column:
    """``struct(a, b)`` of consecutive points."""
    return _pairs(ring, lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def polygon_area(rings: Column) -> Column:
    """Shell less holes."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return ring_area(rings[0]) - _total(F.transform(holes, ring_area))


def area(polys: Column) -> Column:
    return _total(F.transform(polys, polygon_area))


def points(polys: Column) -> Column:
    return F.flatten(F.flatten(polys))


def bounds(polys: Column) -> Column:
    """``struct(xmin, ymin, xmax, ymax)``, NULL without points."""
    xs, ys = F.transform(points(polys), lambda p: p["x"]), F.transform(points(polys), lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return F.when(F.size(points(polys)) > 0, box)


def envelope_metrics(polys: Column) -> Column:
    """``struct(width, height, area, perimeter)`` of the bounding rectangle."""
    b = bounds(polys)
    w, h = b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]
    return F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area"), (2 * (w + h)).alias("perimeter"))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A polygon list with one closed rectangle."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax), corner(xmin, ymin))))


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """Edges of a closed ring that a ray from the point to the right crosses; a vertex counts with its lower edge."""

    def hit(p: Column, q: Column) -> Column:
        spans = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(_pairs(ring, hit), F.lit(0), lambda a, v: a + v)


def contains(polys: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings of each polygon, so holes are outside."""
    odd = lambda rings: F.aggregate(F.transform(rings, lambda r: crossings(r, x, y)), F.lit(0), lambda a, v: a + v) % 2 == 1
    return F.exists(polys, odd)


def is_usable(geometry: Column) -> Column:
    """Neither NULL nor empty."""
    return geometry.isNotNull() & (F.size(F.coalesce(geometry["polys"], F.expr(f"cast(array() as {_POLYS})"))) > 0)


def _wrap(kind: Column, polys: Column) -> Column:
    return F.struct(kind.alias("type"), polys.alias("polys"))


def force_polygonal(geometry: Column) -> Column:
    """Polygons stay; a collection keeps its polygonal parts as one multipolygon; anything else is NULL.

    Readers put the polygonal parts of a collection, however deep, into ``polys``; :func:`terracell.operators.overlay.repair` unites parts that overlap.
    """
    kind = geometry["type"]
    many = F.when(kind == "GeometryCollection", F.lit("MultiPolygon")).otherwise(kind)
    return F.when(kind.isin("Polygon", "MultiPolygon", "GeometryCollection") & is_usable(geometry), _wrap(many, geometry["polys"]))


def drop_degenerate(geometry: Column) -> Column:
    """Without rings of no area and repeated points; a polygon whose shell goes, goes.  NULL when nothing is left.

    Self-crossing shells are not mended here; see :func:`terracell.operators.overlay.repair`.
    """
    def points_once(r: Column) -> Column:
        kept = F.filter(r, lambda p, i: (i == 0) | (F.get(r, i - 1) != p))
        return kept

    rings = lambda poly: F.filter(F.transform(poly, points_once), lambda r: (F.size(r) >= 4) & (ring_area(r) > 0))
    kept = F.filter(F.transform(geometry["polys"], lambda p: F.when((F.size(p) > 0) & (ring_area(p[0]) > 0), rings(p))), lambda p: p.isNotNull() & (F.size(p) > 0))
    return F.when(is_usable(geometry) & (F.size(kept) > 0), _wrap(geometry["type"], kept))


def transform_points(geometry: Column, f: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Every point through ``f(x, y)``."""

    def one(p: Column) -> Column:
        x, y = f(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    moved = F.transform(geometry["polys"], lambda poly: F.transform(poly, lambda ring: F.transform(ring, one)))
    return F.when(geometry.isNotNull(), _wrap(geometry["type"], moved))


def padded_bounds(box: Column, share: float = 0.05) -> Column:
    """Bounds with a margin of a share of each side, or 1 where a side is 0."""
    w, h = box["xmax"] - box["xmin"], box["ymax"] - box["ymin"]
    px, py = F.when(w > 0, w * share).otherwise(F.lit(1.0)), F.when(h > 0, h * share).otherwise(F.lit(1.0))
    return F.struct((box["xmin"] - px).alias("xmin"), (box["ymin"] - py).alias("ymin"), (box["xmax"] + px).alias("xmax"), (box["ymax"] + py).alias("ymax"))


def to_geojson(geometry: Column) -> Column:
    """GeoJSON text of a geometry."""
    rings = F.transform(geometry["polys"], lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(rings, F.lit(0)).alias("coordinates")))
    return F.when(geometry.isNotNull(), F.when(F.size(geometry["polys"]) == 1, single).otherwise(multi))
