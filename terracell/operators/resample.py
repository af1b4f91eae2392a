"""Regridding as equi-joins and hash aggregates.

Each source cell knows by arithmetic which target cells it touches, so overlaps come from
``explode(sequence(lo, hi))`` and a group-by, never from a range join.  Nearest, bilinear
and cubic go the other way: each target centre knows its source cells.  Grids of different CRS or
with rotation work too: a source cell then is a polygon among the target's cells, and overlaps are areas in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import projections as J
from ..model import GridSpec
from . import grid as G

#: Accepted methods (fixed values).
METHODS = ("nearest", "bilinear", "cubic", "average", "mode", "max", "min", "med", "q1", "q3")


def method(name: str) -> str:
    m = str(name).strip().lower()
    if m not in METHODS:
        raise ValueError(f"unknown resampling {name!r}; one of {', '.join(METHODS)}")
    return m


def method_names(names: Column) -> Column:
    """The same for a column of names; NULL where :func:`method` raises."""
    m = F.lower(F.trim(names))
    return F.when(m.isin(*METHODS), m)


#: Shares of area below this are rounding.
LEAST_AREA = 1e-9


def _straight(src: GridSpec, dst: GridSpec) -> bool:
    return src.crs == dst.crs and not any(g.transform[k] for g in (src, dst) for k in (1, 3))


def warped_overlaps(cells: DataFrame, src: GridSpec, dst: GridSpec, keys: list[str]) -> DataFrame:
    """``keys, row, col, value, w, area`` for grids of any CRS and rotation, without a join.

    The corners of a source cell go through the projections to columns and rows of the target, and its sides are straight there.  ``area`` is what it
    covers of a target cell, in cells, and ``w`` that area over the area of the whole outline; so what a source cell has is dealt out completely, except
    to where the target has no cells.  Source cells with a corner outside the target's projection have no row.
    """
    outline = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    n = len(outline)
    corner = lambda i: [c.cast("double").alias(f"_{k}{i}") for k, c in zip("xy", G.to_xy(src, F.col("col") + F.lit(outline[i][0]), F.col("row") + F.lit(outline[i][1])))]
    pairs = [(f"_x{i}", f"_y{i}") for i in range(n)]
    s = cells.select(*keys, "value", *[c for i in range(n) for c in corner(i)])
    s = J.on_frame(s, J.between(src.crs, dst.crs), pairs)
    s = s.select(*keys, "value", *[c.alias(f"_{k}{i}") for i in range(n) for k, c in zip("uv", G.to_colrow(dst, F.col(f"_x{i}"), F.col(f"_y{i}")))])
    us, vs = [F.col(f"_u{i}") for i in range(n)], [F.col(f"_v{i}") for i in range(n)]
    ring = [(i, (i + 1) % n) for i in range(n)]
    twice = sum(((us[i] - us[0]) * (vs[j] - vs[0]) - (us[j] - us[0]) * (vs[i] - vs[0]) for i, j in ring[1:-1]), F.lit(0.0))
    lo = lambda v: F.greatest(F.floor(F.array_min(F.array(*v))), F.lit(0)).cast("int")
    hi = lambda v, m: F.least(F.ceil(F.array_max(F.array(*v))) - 1, F.lit(m - 1)).cast("int")
    known = F.lit(True)
    for c in us + vs:
        known = known & c.isNotNull()
    # Each edge from its upper end, so that it gives the same number, with the other sign, to the outlines on both its sides.
    edges = []
    for k, (i, j) in enumerate(ring):
        down = vs[i] <= vs[j]
        edges += [F.when(down, us[i]).otherwise(us[j]).alias(f"_x{k}"), F.when(down, vs[i]).otherwise(vs[j]).alias(f"_y{k}"), F.when(down, vs[j]).otherwise(vs[i]).alias(f"_z{k}"),
                  F.try_divide(us[j] - us[i], vs[j] - vs[i]).alias(f"_s{k}"), F.when(down, 1.0).otherwise(-1.0).alias(f"_d{k}")]
    s = s.where(known).select(*keys, "value", (F.abs(twice) / 2).alias("_all"), lo(us).alias("_lc"), hi(us, dst.width).alias("_hc"), lo(vs).alias("_lr"), hi(vs, dst.height).alias("_hr"), *edges)
    e = s.where("_all > 0 and _lc <= _hc and _lr <= _hr").withColumn("col", F.explode(F.sequence("_lc", "_hc"))).withColumn("row", F.explode(F.sequence("_lr", "_hr")))
    # Of each edge the part within the target cell's row, and where it enters and leaves that row, from the cell's left side.
    held = ["row", "col", "value", "_all"]
    near = lambda y: F.least(F.greatest(F.col(y), F.col("row").cast("double")), F.col("row") + 1.0)
    e = e.select(*keys, *held, *[f"_{m}{k}" for k in range(n) for m in "xysd"], *[near(f"_{y}{k}").alias(f"_{t}{k}") for k in range(n) for y, t in ("yt", "zl")])
    at = lambda k, t: F.col(f"_x{k}") + (F.col(f"_{t}{k}") - F.col(f"_y{k}")) * F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) - F.col("col")
    e = e.select(*keys, *held, *[((F.col(f"_l{k}") - F.col(f"_t{k}")) * F.col(f"_d{k}")).alias(f"_h{k}") for k in range(n)], *[at(k, t).alias(f"_{m}{k}") for k in range(n) for t, m in ("ta", "lb")])
    # The mean, along that part, of the width of the cell to the left of the edge: the integral of a ramp from 0 to 1.
    ramp = lambda d: F.when(d <= 0, 0.0).when(d >= 1, d - 0.5).otherwise(d * d / 2)
    a, b = (lambda k: F.col(f"_a{k}")), (lambda k: F.col(f"_b{k}"))
    flat = lambda k: F.least(F.greatest((a(k) + b(k)) / 2, F.lit(0.0)), F.lit(1.0))
    width = lambda k: F.when(F.abs(b(k) - a(k)) < 1e-7, flat(k)).otherwise((ramp(b(k)) - ramp(a(k))) / (b(k) - a(k)))
    covered = F.abs(sum((width(k) * F.col(f"_h{k}") for k in range(n)), F.lit(0.0)))
    e = e.select(*keys, "row", "col", "value", "_all", J.settled(covered).alias("area"))
    return e.select(*keys, "row", "col", "value", (F.col("area") / F.col("_all")).alias("w"), "area").where((F.col("area") > LEAST_AREA) | (F.col("w") > LEAST_AREA))


def overlaps(cells: DataFrame, src: GridSpec, dst: GridSpec, keys: list[str]) -> DataFrame:
    """``keys, row, col, value, w, area``: a row for each source cell and target cell that share area; ``w`` is the shared part of the source cell's area, and ``area`` weighs
    source cells against one another (the same as ``w`` where both grids have one CRS)."""
    if not _straight(src, dst):
        return warped_overlaps(cells, src, dst, keys)
    x0, y0 = G.to_xy(src, F.col("col"), F.col("row"))
    x1, y1 = G.to_xy(src, F.col("col") + 1, F.col("row") + 1)
    c0, r0 = G.to_colrow(dst, x0, y0)
    c1, r1 = G.to_colrow(dst, x1, y1)
    # Borders that only differ by rounding touch, they do not overlap.
    snap = lambda v: F.when(F.abs(v - F.rint(v)) < 1e-9, F.rint(v)).otherwise(v)
    s = cells.select(*keys, "value", snap(F.least(c0, c1)).alias("_c0"), snap(F.greatest(c0, c1)).alias("_c1"), snap(F.least(r0, r1)).alias("_r0"), snap(F.greatest(r0, r1)).alias("_r1"))
    lo = lambda a: F.greatest(F.floor(a), F.lit(0)).cast("int")
    hi = lambda b, n: F.least(F.ceil(b) - 1, F.lit(n - 1)).cast("int")
    s = s.withColumns({"_lc": lo("_c0"), "_hc": hi("_c1", dst.width), "_lr": lo("_r0"), "_hr": hi("_r1", dst.height)}).where("_lc <= _hc and _lr <= _hr")
    e = s.withColumn("col", F.explode(F.sequence("_lc", "_hc"))).withColumn("row", F.explode(F.sequence("_lr", "_hr")))
    part = lambda a, b, i: F.greatest(F.least(F.col(b), F.col(i) + 1) - F.greatest(F.col(a), F.col(i)), F.lit(0.0)) / (F.col(b) - F.col(a))
    return e.select(*keys, "row", "col", "value", (part("_c0", "_c1", "col") * part("_r0", "_r1", "row")).alias("w")).withColumn("area", F.col("w"))


def _by_overlap(cells: DataFrame, src: GridSpec, dst: GridSpec, how: str, keys: list[str], accuracy: int | None = None) -> DataFrame:
    o = overlaps(cells.where("value is not null"), src, dst, keys)
    by = [*keys, "row", "col"]
    if how == "mode":
        n = o.groupBy(*by, "value").agg(F.sum("area").alias("_w"))
        # Ties go to the smallest value; weights are compared after rounding, as their sums depend on the order.
        return n.groupBy(*by).agg(F.max_by("value", F.struct(F.round("_w", 9), -F.col("value"))).alias("value"))
    v, w, area = F.col("value"), F.col("w"), F.col("area")
    quantile = (lambda q: F.percentile(v, q)) if accuracy is None else (lambda q: F.percentile_approx(v, q, accuracy))
    agg = {
        "average": F.sum(v * area) / F.sum(area), "sum": F.sum(v * w), "max": F.max(v), "min": F.min(v),
        "med": quantile(0.5), "q1": quantile(0.25), "q3": quantile(0.75),
    }[how]
    return o.groupBy(*by).agg(agg.alias("value"))


def _kernel_cubic(d: Column) -> Column:
    """Keys weights with a = -0.5 at distance ``d``."""
    t = F.abs(d)
    near = 1.5 * t * t * t - 2.5 * t * t + 1
    far = -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2
    return F.when(t <= 1, near).when(t < 2, far).otherwise(F.lit(0.0))


def sample(cells: DataFrame, src: GridSpec, wanted: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """Values at points: ``wanted`` has ``row, col`` of the target and ``x, y`` in the source's CRS.

    Weights of missing neighbours go to the others; a point without any gives no row.
    """
    at_col, at_row = G.to_colrow(src, F.col("x"), F.col("y"))
    p = wanted.select("row", "col", at_col.alias("_x"), at_row.alias("_y")).where("_x is not null and _y is not null")
    inside = (F.col("_x") >= 0) & (F.col("_x") < src.width) & (F.col("_y") >= 0) & (F.col("_y") < src.height)
    if how == "nearest":
        near = p.where(inside).select("row", "col", F.floor("_x").cast("int").alias("_sc"), F.floor("_y").cast("int").alias("_sr"), F.lit(1.0).alias("_w"))
    else:
        spread, weight = ((0, 1), lambda d: F.greatest(1 - F.abs(d), F.lit(0.0))) if how == "bilinear" else ((-1, 0, 1, 2), _kernel_cubic)
        q = p.where(inside).select("row", "col", (F.col("_x") - 0.5).alias("_u"), (F.col("_y") - 0.5).alias("_v"))
        steps = F.array(*[F.lit(i) for i in spread])
        q = q.withColumn("_sc", F.explode(F.transform(steps, lambda i: F.floor("_u").cast("int") + i))).withColumn("_sr", F.explode(F.transform(steps, lambda i: F.floor("_v").cast("int") + i)))
        near = q.select("row", "col", "_sc", "_sr", (weight(F.col("_u") - F.col("_sc")) * weight(F.col("_v") - F.col("_sr"))).alias("_w")).where("_w <> 0")
    source = cells.where("value is not null").select(*keys, F.col("row").alias("_sr"), F.col("col").alias("_sc"), "value")
    joined = near.join(source, ["_sr", "_sc"])
    if how == "nearest":
        return joined.select(*keys, "row", "col", "value")
    out = joined.groupBy(*keys, "row", "col").agg(F.sum(F.col("value") * F.col("_w")).alias("_n"), F.sum("_w").alias("_d"))
    return out.where("abs(_d) > 1e-9").select(*keys, "row", "col", (F.col("_n") / F.col("_d")).alias("value"))


def regrid(cells: DataFrame, src: GridSpec | dict, dst: GridSpec | dict, how: str = "nearest", keys: list[str] | None = None, fill: float | None = None, accuracy: int | None = None) -> DataFrame:
    """Cells of ``src`` on ``dst``: ``keys, row, col, value``.

    Medians and quartiles are exact and interpolate, for which a task holds the distinct values of a target cell.  With ``accuracy`` they are values of the cell whose rank is
    off by at most one part in ``accuracy``, from sketches of bounded size that tasks make and the shuffle merges: for targets so coarse that a cell has millions of sources.

    The grids may differ in CRS and rotation: methods that look up points take them through the projections, and the others
    weigh by area in the target's CRS.  Target cells without a valid source cell have no row; with ``fill`` every target cell has one (single layer only).
    """
    src, dst, how, keys = GridSpec.of(src), GridSpec.of(dst), method(how), list(keys or [])
    if how in ("nearest", "bilinear", "cubic"):
        x, y = G.centres(dst, F.col("col"), F.col("row"))
        wanted = G.cells(cells.sparkSession, dst).select("row", "col", x.alias("x"), y.alias("y"))
        out = sample(cells, src, J.on_frame(wanted, J.between(dst.crs, src.crs), [("x", "y")]), how, keys)
    else:
        out = _by_overlap(cells, src, dst, how, keys, accuracy)
    if fill is None:
        return out
    if keys:
        raise ValueError("fill needs a single layer")
    return G.cells(cells.sparkSession, dst).join(out, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(float(fill))).alias("value"))


def regrid_counts(cells: DataFrame, src: GridSpec | dict, dst: GridSpec | dict, integer: bool = False, exact: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Counts on a coarser grid.

    The default takes the mean of the valid overlaps times the ratio of the cell areas, so partly covered target cells
    count too much; ``exact`` adds up shares of source cells and conserves the total.  ``integer``: rounded half to even.
    Grids of different CRS have no ratio of areas, so their counts are always exact.
    """
    src, dst, keys = GridSpec.of(src), GridSpec.of(dst), list(keys or [])
    if exact or src.crs != dst.crs:
        out = _by_overlap(cells, src, dst, "sum", keys)
    else:
        out = _by_overlap(cells, src, dst, "average", keys).withColumn("value", F.col("value") * (dst.cell_area / src.cell_area))
    return out.withColumn("value", F.rint("value").cast("long") if integer else F.col("value").cast("float"))


def reduce_cells(cells: DataFrame, src: GridSpec, dst: GridSpec, reducer: str, keys: list[str] | None = None) -> DataFrame:
    """Overlap-weighted ``sum``, ``mean`` or ``mode``."""
    return _by_overlap(cells, src, dst, {"sum": "sum", "mean": "average", "mode": "mode"}[reducer], list(keys or []))
