from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import geometry as P
from terracell.functions import stitching
from terracell.operators import vector


def border(grid, shear):
    """Directed border edges of the set cells of a sheared grid, with the inside on their left."""
    out = {}
    for r, c in zip(*np.nonzero(grid)):
        corners = [(c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1)]
        for a, b in zip(corners, corners[1:] + corners[:1]):
            if out.pop((b, a), None) is None:
                out[a, b] = 1
    e = np.array([[*a, *b] for a, b in out], float).reshape(-1, 4).T
    return e[0] + shear * e[1], e[1], e[2] + shear * e[3], e[3]


def cells_in(polygon, shape, shear):
    """The cells whose centre is in the polygon, by the even-odd rule over all its rings."""
    r, c = np.indices(shape)
    px, py = (c + 0.5 + shear * (r + 0.5))[..., None], (r + 0.5)[..., None]
    n = 0
    for x, y in polygon:
        spans = (y[:-1] > py) != (y[1:] > py)
        rise = np.where(y[1:] == y[:-1], 1.0, y[1:] - y[:-1])
        n = n + (spans & (px < x[:-1] + (py - y[:-1]) * (x[1:] - x[:-1]) / rise)).sum(axis=-1)
    return n % 2 == 1


def connected(cells):
    todo = {tuple(p) for p in np.argwhere(cells)}
    edge = [todo.pop()]
    while edge:
        r, c = edge.pop()
        near = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & todo
        todo -= near
        edge += near
    return not todo


def test_random_coverages():
    """Each connected set of cells is one polygon with its own holes, whatever touches at corners."""
    rng = np.random.default_rng(3)
    holes = 0
    for _ in range(300):
        grid = rng.random(rng.integers(1, 15, 2)) < rng.choice([0.4, 0.6, 0.8, 0.9])
        shear = float(rng.choice([0, 0.37, -1.3]))
        edges = border(grid, shear)
        polys = stitching.polygons(*edges)
        again = rng.permutation(len(edges[0]))
        for p, q in zip(polys, stitching.polygons(*[v[again] for v in edges])):
            assert all((a == b).all() for a, b in zip(p, q)) and len(p) == len(q)
        rings = [list(zip(*r.tolist())) for p in polys for r in p]
        assert all(r[0] == r[-1] and len(set(r)) == len(r) - 1 for r in rings)
        assert sorted((*a, *b) for r in rings for a, b in zip(r, r[1:])) == sorted(zip(*[v.tolist() for v in edges]))
        held = [cells_in(p, grid.shape, shear) for p in polys]
        assert (np.sum(held, axis=0) == grid).all() and all(map(connected, held)) if held else not grid.any()
        holes += len(rings) - len(polys)
    assert holes > 200


def test_overlapping_rings_keep_their_area():
    ring = lambda x, y, w, h: [((x, y), (x + w, y)), ((x + w, y), (x + w, y + h)), ((x + w, y + h), (x, y + h)), ((x, y + h), (x, y))]
    back = lambda edges: [(b, a) for a, b in edges]
    # A box with a hole, a box across the space below the hole, and one there twice.
    edges = [*ring(0, 0, 10, 10), *back(ring(4, 4, 2, 2)), *ring(1, 1, 8, 1), *ring(20, 0, 3, 3), *ring(20, 0, 3, 3)]
    got = stitching.polygons(*np.array([[*a, *b] for a, b in edges], float).T)
    assert [len(p) for p in got] == [1, 1, 1, 2] and [np.ptp(p[0][0]) for p in got] == [8, 3, 3, 10]


def test_open_rings_raise():
    with pytest.raises(ValueError, match="not closed"):
        stitching.polygons(*np.array([[0, 0, 1, 0], [1, 0, 1, 1]], float).T)
    with pytest.raises(ValueError, match="no number"):
        stitching.polygons(*np.array([[0, 0, 1, 0], [1, 0, np.nan, 1], [np.nan, 1, 0, 0]], float).T)


def test_coverage_of_many_holes(spark):
    n, k = 160_000, F.col("id")
    x, y = k % 10, F.floor(k / 10)
    squares = spark.range(n).where(k % 23 != 0).select(F.lit(1).alias("k"), F.struct(F.lit("Polygon").alias("type"), P.rectangle(x, y, x + 1, y + 1).alias("polys")).alias("geometry"))
    polys = F.col("geometry.polys")
    began = time.perf_counter()
    got = vector.dissolve_coverage(squares, ["k"]).select(P.area(polys), F.size(F.flatten(polys)) - F.size(polys), F.size(polys)).collect()
    assert time.perf_counter() - began < 60  # a search for the shell of each hole takes minutes
    holes = sum(1 for i in range(0, n, 23) if 0 < i % 10 < 9 and 0 < i // 10 < n // 10 - 1)
    assert got == [(float(n - len(range(0, n, 23))), holes, 1)]
