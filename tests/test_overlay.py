from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import arrangement as A
from terracell.functions import geometry as P
from terracell.operators import overlay

SHAPES = "k string, note string, geometry struct<type:string,polys:array<array<array<struct<x:double,y:double>>>>>"
ring = lambda *pts: np.array(pts, float).T
box = lambda x, y, w, h: ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))


def area(polys):
    return sum(float((r[0, :-1] * r[1, 1:] - r[0, 1:] * r[1, :-1]).sum()) / 2 for p in polys for r in p)


def covered(polys, lines):
    """Length covered along horizontal lines: each polygon by the even-odd rule, then together."""
    total = 0.0
    for y in lines:
        spans = []
        for p in polys:
            xs = []
            for r in p:
                q = np.concatenate([r, r[:, :1]], axis=1)
                k = np.flatnonzero((q[1, :-1] > y) != (q[1, 1:] > y))
                xs += (q[0, k] + (y - q[1, k]) * (q[0, k + 1] - q[0, k]) / (q[1, k + 1] - q[1, k])).tolist()
            spans += zip(sorted(xs)[::2], sorted(xs)[1::2])
        end = -math.inf
        for a, b in sorted(spans):
            if b > end:
                total += b - max(a, end)
                end = b
    return total


def geometry(polys, kind="Polygon"):
    return {"type": kind, "polys": [[[{"x": float(x), "y": float(y)} for x, y in r.T] for r in p] for p in polys]}


def polys_of(shape):
    return [[np.array([[p["x"], p["y"]] for p in r]).T for r in poly] for poly in shape["polys"]]


def valid(polys):
    """No two edges cross, no point twice in a ring, shells run counterclockwise and holes clockwise."""
    for p in polys:
        for i, r in enumerate(p):
            assert (r[:, 0] == r[:, -1]).all() and len({tuple(q) for q in r[:, :-1].T}) == r.shape[1] - 1
            assert (area([[r]]) > 0) == (i == 0)


def test_small_cases():
    assert [len(p) for p in overlay.resolve([[ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))]])] == [1, 1]
    assert area(overlay.resolve([[ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))]])) == 2
    assert area(overlay.resolve([[box(0, 0, 2, 2)], [box(1, 1, 2, 2)]])) == 7
    assert area(overlay.resolve([[box(0, 0, 4, 4), box(1, 1, 2, 2)], [box(1.5, 1.5, 1, 1)]])) == 13
    spike = overlay.resolve([[ring((0, 0), (1, 0), (1, 2), (1, 5), (1, 2), (0, 2), (0, 0))]])
    assert area(spike) == 2 and spike[0][0][1].max() == 2
    assert overlay.resolve([[ring((0, 0), (1, 1), (2, 2), (0, 0))]]) == [] == overlay.resolve([]) == overlay.resolve([[ring((0, 0), (math.nan, 1), (1, 0))]])
    # Squares that touch in corners are polygons of their own; a ring of squares has a hole.
    corner = overlay.resolve([[box(0, 0, 1, 1)], [box(1, 1, 1, 1)]])
    assert [len(p) for p in corner] == [1, 1]
    around = overlay.resolve([[box(0, 0, 3, 1)], [box(0, 2, 3, 1)], [box(0, 0, 1, 3)], [box(2, 0, 1, 3)]])
    assert [len(p) for p in around] == [2] and area(around) == 8
    # An open ring is closed; a valid ring keeps its corners.
    pentagon = ring((0.1, 0.2), (1.3, 0.1), (1.7, 0.9), (0.8, 1.6), (0.05, 0.7))
    assert {tuple(q) for q in overlay.resolve([[pentagon]])[0][0].T} == {tuple(q) for q in pentagon.T}


def test_random_polygons_cover_the_same():
    rng = random.Random(4)
    lines = (np.arange(2000) + 0.5) / 200
    for _ in range(12):
        polys = [[np.array([[rng.uniform(0, 10) for _ in range(n)] for _ in range(2)])] for n in [rng.randrange(3, 12) for _ in range(rng.randrange(1, 10))]]
        out = overlay.resolve(polys)
        valid(out)
        want = covered(polys, lines) / 200
        assert area(out) == pytest.approx(want, abs=5e-3)
        assert covered([[r for p in out for r in p]], lines) / 200 == pytest.approx(want, abs=5e-3)
        assert area(overlay.resolve(out)) == pytest.approx(area(out), abs=1e-6)


def test_strips_agree():
    rng = random.Random(6)
    e = tuple(np.array([rng.randrange(200) for _ in range(150)]) for _ in range(4))
    closed = tuple(np.concatenate(v) for v in zip(e, (e[2], e[3], e[0] + 1, e[1]), (e[0] + 1, e[1], e[0], e[1])))
    one = A.boundary(*closed, odd=True, strip_edges=10_000)
    many = A.boundary(*closed, odd=True, strip_edges=4)
    assert sorted(zip(*(v.tolist() for v in one))) == sorted(zip(*(v.tolist() for v in many))) and len(one[0])


def test_nearly_parallel_edges():
    bent = ring((0, 0), (1, 1e-9), (2, 0), (3, 1e-9), (3, 1), (0, 1), (0, 0))
    assert area(overlay.resolve([[bent], [box(0, 0, 3, 1)]])) == pytest.approx(3, abs=1e-7)
    fan = [[ring((0, 0), (1000, k), (1000, k + 1), (0, 0))] for k in range(0, 100, 2)]
    assert area(overlay.resolve(fan)) == pytest.approx(25_000, rel=1e-6)


@pytest.mark.parametrize("strip_edges", [3, 256])
def test_union_of_rows(spark, strip_edges):
    rng = random.Random(9)
    rows, want = [], {}
    for k in ("a", "b", None):
        polys = [[np.array([[rng.uniform(0, 10) for _ in range(n)] for _ in range(2)])] for n in (3, 5, 9, 4, 6)] + [[box(2, 2, 3, 3), box(3, 3, 1, 1)]]
        rows += [(k, "n", geometry([p])) for p in polys] + [(k, "n", geometry([polys[0]]))]
        want[k] = area(overlay.resolve(polys))
    rows += [("gone", "n", None), ("gone", "n", geometry([])), ("flat", "n", geometry([[ring((0, 0), (1, 1), (0, 0))]])), ("a", "n", geometry([], "Point"))]
    df = spark.createDataFrame(rows, SHAPES).repartition(3)
    got = {r["k"]: polys_of(r["geometry"]) for r in overlay.union(df, ["k"], strip_edges=strip_edges).collect()}
    assert set(got) == set(want)
    for k, polys in got.items():
        valid(polys)
        assert area(polys) == pytest.approx(want[k], rel=1e-6)
    assert overlay.union(df.where("k = 'gone'"), ["k"]).count() == 0


def test_repair_keeps_columns(spark):
    bow = ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))
    df = spark.createDataFrame([("a", None, geometry([[bow]])), ("b", "x", geometry([[box(0, 0, 2, 2)], [box(1, 0, 2, 2)]], "GeometryCollection")), ("c", "y", None)], SHAPES)
    got = {r["k"]: (r["note"], r["geometry"]["type"], r["a"]) for r in overlay.repair(df).withColumn("a", P.area(F.col("geometry.polys"))).collect()}
    assert got == {"a": (None, "MultiPolygon", 2.0), "b": ("x", "Polygon", 6.0)}
    assert overlay.repair(df.where("k = 'none'")).count() == 0


def test_far_coordinates():
    """A square of a metre, far away: the grid is never finer than doubles are there."""
    out = overlay.resolve([[box(2.0**40, 2.0**41, 1, 1)], [box(2.0**40 + 0.5, 2.0**41, 1, 1)]])
    near = [[r - np.array([[2.0**40], [2.0**41]]) for r in p] for p in out]
    assert area(near) == pytest.approx(1.5, rel=1e-2) and len(out) == 1
