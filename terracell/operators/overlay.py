"""Union and repair of polygons that overlap or cross themselves.

A row's geometry is mended where it lies.  The union of all rows of a key is an arrangement in Spark: edges are dealt to
strips of rows, each task cuts the edges of its strip where they meet, pieces that coincide are counted together, and in strips again a
ray to the middle of each piece tells which sides of it are inside.  Only edges of the final border come together for a key, to be
stitched into rings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import arrangement as A
from ..functions import geometry as P
from ..model import GEOMETRY

#: Edges that a strip of a key has on average, and strips of a key at most.
STRIP_EDGES, MOST_STRIPS = 256, 1 << 20
#: Rows mended at once.
BATCH_ROWS = 1024
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_GEOMETRY = "struct<type:string,polys:array<array<array<struct<x:double,y:double>>>>>"


def resolve(polys: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Valid polygons that cover what ``polys`` do: each polygon's rings by the even-odd rule, then the polygons together.

    A ring is an array of two rows, x and y.  Shells run counterclockwise and holes clockwise; rings without area go, and so do
    polygons with a coordinate that is no number.  Corners keep their coordinates; crossings are rounded to 2**-29 of the longer side.
    """
    polys = [[r for r in p if r.shape[1]] for p in polys]
    polys = [p for p in polys if p and all(np.isfinite(r).all() for r in p)]
    if not polys:
        return []
    points = np.concatenate([r for p in polys for r in p], axis=1)
    low, high = points.min(axis=1), points.max(axis=1)
    step = A.unit(low[0], low[1], high[0], high[1])
    base = np.floor(low / step)[:, None]
    whole = lambda r: (np.rint(r / step) - base).astype(np.int64)
    if len(polys) == 1 and len(polys[0]) == 1 and (turned := A.simple(whole(polys[0][0]))):
        r = polys[0][0]
        r = r if (r[:, 0] == r[:, -1]).all() else np.concatenate([r, r[:, :1]], axis=1)
        r = r[:, np.concatenate(([True], (r[:, 1:] != r[:, :-1]).any(axis=0)))]
        return [[r if turned > 0 else r[:, ::-1]]]
    borders = []
    for p in polys:
        parts = [(i[0, :-1], i[1, :-1], i[0, 1:], i[1, 1:]) for i in (whole(np.concatenate([r, r[:, :1]], axis=1)) for r in p)]
        borders.append(A.boundary(*[np.concatenate(v) for v in zip(*parts)], odd=True))
    edges = borders[0] if len(borders) == 1 else A.boundary(*[np.concatenate(v) for v in zip(*borders)], odd=False)
    known = {k: (x, y) for *k_, x, y in zip(*whole(points).tolist(), *points.tolist()) if (k := tuple(k_))}
    back = lambda x, y: known.get((x, y)) or ((x + base[0, 0]) * step, (y + base[1, 0]) * step)
    return [[np.array([back(x, y) for x, y in r.T.tolist()]).T for r in p] for p in A.polygons(A.rings(edges))]


def _rows(column: pa.Array) -> Iterator[list[list[np.ndarray]]]:
    """Each row's polygons as rings of two rows of numbers."""
    polys = pc.struct_field(column, "polys")
    rings = pc.list_flatten(polys)
    points = pc.list_flatten(rings)
    lengths = lambda a: np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False))))
    rows, of_poly, of_ring = lengths(polys), lengths(rings), lengths(points)
    flat = pc.list_flatten(points)
    xy = np.stack([pc.fill_null(pc.struct_field(flat, k), math.nan).to_numpy(zero_copy_only=False) for k in "xy"])
    for a, b in zip(rows[:-1], rows[1:]):
        yield [[xy[:, of_ring[r] : of_ring[r + 1]] for r in range(of_poly[p], of_poly[p + 1])] for p in range(a, b)]


def _column(rows: list[list[list[np.ndarray]]]) -> pa.Array:
    """Geometries from polygons; a row without any is null."""
    polys = [p for row in rows for p in row]
    rings = [r for p in polys for r in p]
    xy = np.concatenate([np.zeros((2, 0)), *rings], axis=1)
    offsets = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(xy[0]), pa.array(xy[1])], fields=list(_POINT))
    nested = pa.ListArray.from_arrays(offsets([r.shape[1] for r in rings]), points)
    nested = pa.ListArray.from_arrays(offsets([len(p) for p in polys]), nested)
    nested = pa.ListArray.from_arrays(offsets([len(row) for row in rows]), nested)
    kinds = pa.array(["Polygon" if len(row) == 1 else "MultiPolygon" for row in rows])
    return pa.StructArray.from_arrays([kinds, nested], ["type", "polys"], mask=pa.array([not row for row in rows]))


def repair(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """All columns with valid geometries; rows whose geometry is null, empty or vanishes go.

    See :func:`resolve`: a bow-tie becomes two polygons, spikes go, and overlapping parts of one geometry, such as a collection's, are united, so their
    area counts once.  Points and lines go.  No shuffle.
    """
    at = features.columns.index(geometry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH_ROWS):
                c = b.slice(i, BATCH_ROWS)
                fixed = _column([resolve(row) for row in _rows(c.column(at))])
                yield pa.RecordBatch.from_arrays([fixed if k == at else v for k, v in enumerate(c.columns)], c.schema.names)

    usable = features.where(P.is_usable(F.col(geometry))).withColumn(geometry, F.struct(F.col(geometry)["type"].alias("type"), F.col(geometry)["polys"].alias("polys")))
    # What vanishes comes back as null.
    schema = StructType([StructField(f.name, GEOMETRY if f.name == geometry else f.dataType, True) for f in usable.schema])
    return usable.mapInArrow(run, schema).where(F.col(geometry).isNotNull())


def _canonical(edges: DataFrame, net) -> DataFrame:
    """``_g, ax, ay, bx, by, net``: each edge once, from its smaller end, with its net direction; those that cancel go."""
    a, b = F.struct("ax", "ay"), F.struct("bx", "by")
    pick = lambda p, q: F.when(a < b, F.col(p)).otherwise(F.col(q)).alias(p)
    turned = edges.where(a != b).select("_g", pick("ax", "bx"), pick("ay", "by"), pick("bx", "ax"), pick("by", "ay"), F.when(a < b, net).otherwise(-net).alias("net"))
    return turned.groupBy("_g", "ax", "ay", "bx", "by").agg(F.sum("net").alias("net")).where("net <> 0")


def _dealt(edges: DataFrame, strips: DataFrame, pad: int) -> DataFrame:
    """A row for each edge and strip of its key that it comes within ``pad`` rows of."""
    row = lambda y: F.floor((y - F.col("_y0")) / F.col("_h"))
    lo, hi = row(F.least("ay", "by") - pad), row(F.greatest("ay", "by") + pad)
    return edges.join(strips, "_g").select("_g", "_y0", "_h", F.explode(F.sequence(lo, hi)).alias("_row"), "ax", "ay", "bx", "by", "net")


def _edges(t: pa.Table) -> tuple[A.Edges, np.ndarray, int, int]:
    column = lambda k: t.column(k).to_numpy()
    low = int(t.column("_y0")[0].as_py() + t.column("_row")[0].as_py() * t.column("_h")[0].as_py())
    return tuple(map(column, ("ax", "ay", "bx", "by"))), column("net"), low, low + int(t.column("_h")[0].as_py())


def _cut_strip(t: pa.Table) -> pa.Table:
    edges, net, low, high = _edges(t)
    e, x, y = A.cuts(edges, low, high)
    at = (edges[2][e] - edges[0][e]) * (x - edges[0][e]) + (edges[3][e] - edges[1][e]) * (y - edges[1][e])
    keep = t.select(["_g", "ax", "ay", "bx", "by", "net"]).take(pa.array(e))
    return keep.append_column("at", pa.array(at)).append_column("x", pa.array(x)).append_column("y", pa.array(y))


def _border_strip(t: pa.Table) -> pa.Table:
    edges, net, low, high = _edges(t)
    middle = edges[1] + edges[3]
    own = np.flatnonzero((middle >= 2 * low) & (middle < 2 * high))
    left, right = A.inside(edges, net, own, odd=False)
    border = A.directed(tuple(v[own] for v in edges), left, right)
    key = t.select(["_g"]).take(pa.array(own[left != right]))
    for k, v in zip(("ax", "ay", "bx", "by"), border):
        key = key.append_column(k, pa.array(v))
    return key


def union(features: DataFrame, keys: list[str], geometry: str = "geometry", strip_edges: int = STRIP_EDGES) -> DataFrame:
    """One geometry per combination of ``keys``: what its rows cover, whether they touch, overlap or cross themselves.

    Null keys are a key of their own; rows that :func:`repair` drops go, and so do keys without others.  Coordinates are rounded to a power of two that is
    about 2**-29 of the longer side of all features, so corners on a binary grid stay where they are.

    Shuffles: edges by themselves and by strip of a key, twice each, then the border by key.  A strip has ``strip_edges`` edges on average; one that has
    more takes longer, in blocks, and no more memory than its edges.  The driver sees the bounds of all features.
    """
    good = repair(features.select(*[F.col(k) for k in keys], F.col(geometry).alias("_shape")), "_shape").select(F.struct(*keys).alias("_g"), F.col("_shape.polys").alias("_polys"))
    box = features.where(P.is_usable(F.col(geometry))).select(P.bounds(F.col(geometry)["polys"]).alias("b")).where(F.col("b").isNotNull())
    low = box.agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).first()
    key_type = good.schema["_g"].dataType.simpleString()
    finite = all(v is not None and math.isfinite(v) for v in low)
    step = A.unit(*low) if finite else 1.0
    x0, y0 = (math.floor(v / step) * step for v in low[:2]) if finite else (0.0, 0.0)
    rings = good.select("_g", F.explode("_polys").alias("_rings")).select("_g", F.explode("_rings").alias("_ring")).select("_g", F.explode(P.edges(F.col("_ring"))).alias("e"))
    whole = lambda c, z: F.rint((F.col(c) - z) / step).cast("long")
    edges = rings.select("_g", whole("e.a.x", x0).alias("ax"), whole("e.a.y", y0).alias("ay"), whole("e.b.x", x0).alias("bx"), whole("e.b.y", y0).alias("by"))
    edges = _canonical(edges, F.lit(1))
    strips = edges.groupBy("_g").agg(F.count("*").alias("n"), (F.min(F.least("ay", "by")) - 1).alias("_y0"), (F.max(F.greatest("ay", "by")) + 1).alias("_y1"))
    count = F.greatest(F.lit(1), F.least(F.lit(MOST_STRIPS), F.floor(F.col("n") / strip_edges)))
    strips = strips.select("_g", "_y0", F.ceil((F.col("_y1") - F.col("_y0") + 1) / count).alias("_h"))

    edge = f"_g {key_type}, ax long, ay long, bx long, by long"
    found = _dealt(edges, strips, 1).groupBy("_g", "_row").applyInArrow(_cut_strip, f"{edge}, net long, at long, x long, y long")
    points = found.groupBy("_g", "ax", "ay", "bx", "by", "net").agg(F.sort_array(F.collect_set(F.struct("at", "x", "y"))).alias("p"))
    n = F.size("p") - 1
    pairs = points.where(n > 0).select("_g", "net", F.explode(F.zip_with(F.slice("p", F.lit(1), n), F.slice("p", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    parts = _canonical(pairs.select("_g", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"), "net"), F.col("net"))
    border = _dealt(parts, strips, 0).groupBy("_g", "_row").applyInArrow(_border_strip, edge)

    def stitch(t: pa.Table) -> pa.Table:
        found = A.polygons(A.rings(tuple(t.column(k).to_numpy() for k in ("ax", "ay", "bx", "by"))))
        shape = [[np.stack([x0 + r[0] * step, y0 + r[1] * step]) for r in p] for p in found]
        return pa.table({"_g": t.column("_g").slice(0, 1), "_shape": _column([shape])})

    whole_rings = border.groupBy("_g").applyInArrow(stitch, f"_g {key_type}, _shape {_GEOMETRY}").where("_shape is not null")
    return whole_rings.select(*[F.col("_g")[k].alias(k) for k in keys], F.col("_shape").alias(geometry))
