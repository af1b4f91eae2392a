from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import geometry as P
from terracell.functions import transverse_mercator as TM
from terracell.model import GridSpec
from terracell.operators import reproject as W
from terracell.operators import vector as V
from terracell.plans import picture


def squares(spark):
    rows = [(float(10 * i), None if i == 3 else float(i)) for i in range(6)]
    x = F.col("x")
    shape = F.struct(F.lit("Polygon").alias("type"), P.rectangle(x, F.lit(0.0), x + 8, F.lit(8.0)).alias("polys"))
    return spark.createDataFrame(rows, "x double, v double").select("v", shape.alias("geometry"))


def pixels(blob):
    w, h = struct.unpack_from(">II", blob, 16)
    at, data = 8, b""
    while at < len(blob):
        n, name = struct.unpack_from(">I4s", blob, at)
        assert struct.unpack_from(">I", blob, at + 8 + n)[0] == zlib.crc32(blob[at + 4 : at + 8 + n])
        data += blob[at + 8 : at + 8 + n] if name == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def test_choropleth(spark, tmp_path):
    f = squares(spark)
    grid = GridSpec.square("LOCAL", -1.0, 9.0, 1.0, 60, 10)
    path = str(tmp_path / "map.png")
    assert picture.draw(f, "v", path, grid) and not picture.draw(f, "v", path, grid)
    blob = open(path, "rb").read()
    p = pixels(blob)
    colour = [tuple(p[5, 1 + 10 * i + 4]) for i in range(6)]
    assert colour == [picture.COLOURS[0], picture.COLOURS[1], picture.COLOURS[2], picture.MISSING, picture.COLOURS[3], picture.COLOURS[4]]
    assert tuple(p[5, 10]) == picture.BACKGROUND and struct.pack(">I", round(200 / 0.0254)) in blob
    g = picture.frame(f, 120)
    assert g.width == 120 and g.bounds[0] < 0 < 58 < g.bounds[2]
    with pytest.raises(ValueError):
        picture.frame(f.limit(0))


def test_mainland_with_insets(spark, tmp_path):
    boxes = [("main", 0.0, 0.0, 80.0, 100.0, 1.0), ("big", 500.0, 0.0, 30.0, 20.0, 2.0), ("small", 900.0, 900.0, 3.0, 3.0, 3.0), ("none", 0.0, 0.0, 1.0, 1.0, None)]
    d = spark.createDataFrame(boxes, "layer string, x double, y double, w double, h double, v double")
    shape = F.struct(F.lit("Polygon").alias("type"), P.rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("polys"))
    f = d.select("layer", "v", shape.alias("geometry"))
    path = str(tmp_path / "insets.png")
    assert picture.draw_with_insets(f, "v", path, "main", side=200) and not picture.draw_with_insets(f, "v", path, "main", side=200)
    p = pixels(open(path, "rb").read())
    assert p.shape == (200, 200, 3)
    frames = {r["layer"]: r for r in picture.inset_frames(f, "main", side=200).collect()}
    assert [frames[k]["slot"] for k in ("main", "big", "small", "none")] == [None, 0, 1, 2]
    for layer, x, y, w, h, v in boxes:
        r = frames[layer]
        corners = [((px - r["left"]) / r["scale"], (r["top"] - py) / r["scale"]) for px, py in ((x, y + h), (x + w, y))]
        # Inside its slot, in the middle of it, as large as it allows.
        assert r["x"] - 1e-6 <= corners[0][0] < corners[1][0] <= r["x"] + r["width"] + 1e-6 and r["y"] - 1e-6 <= corners[0][1] < corners[1][1] <= r["y"] + r["height"] + 1e-6
        col, row = round(sum(c[0] for c in corners) / 2), round(sum(c[1] for c in corners) / 2)
        assert tuple(p[row, col]) != picture.BACKGROUND and (tuple(p[row, col]) == picture.MISSING) == (v is None)
    assert tuple(p[round(frames["big"]["y"]), round(frames["big"]["x"]) + 5]) == picture.BORDER and tuple(p[2, 2]) == picture.BACKGROUND


def meridian(lat):
    """Metres from the equator along a meridian, by summing small steps."""
    e2, n = TM.FLAT * (2 - TM.FLAT), 200_000
    step = math.radians(lat) / n
    return sum(TM.A * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * step) ** 2) ** 1.5 * step for i in range(n))


def test_transverse_mercator(spark):
    utm, tm06 = TM.of_crs("EPSG:32629"), TM.of_crs("epsg:3763")
    assert TM.of_crs("EPSG:25829") == utm and TM.of_crs("EPSG:4326") is None and TM.of_crs("EPSG:32729").north == 1e7
    d = spark.createDataFrame([(lon, lat) for lon in (-12.0, -9.0, -8.6, -6.1) for lat in (-30.0, 0.0, 38.7, 41.2, 60.0)], "lon double, lat double")
    for p in (utm, tm06):
        x, y = p.forward(F.col("lon"), F.col("lat"))
        back = d.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", *[c.alias(n) for c, n in zip(p.inverse(F.col("x"), F.col("y")), ("lon2", "lat2"))]).collect()
        assert all(abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9 for r in back)
    on = d.where("lon = -9").select("lat", *[c.alias(n) for c, n in zip(utm.forward(F.col("lon"), F.col("lat")), "xy")]).collect()
    assert all(abs(r["x"] - 500_000) < 1e-6 and abs(r["y"] - 0.9996 * meridian(r["lat"])) < 1e-3 for r in on)
    # The map is conformal: a small step east is as long as one north, and at a right angle.
    h = 1e-6
    q = d.where("lat > 0").select("lat", *[c.alias(f"{n}{i}") for i, (a, b) in enumerate(((0, 0), (h, 0), (0, h))) for c, n in zip(utm.forward(F.col("lon") + a, F.col("lat") + b), "xy")]).collect()
    for r in q:
        e2, s = TM.FLAT * (2 - TM.FLAT), math.sin(math.radians(r["lat"]))
        east, north = TM.A / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(r["lat"])), TM.A * (1 - e2) / (1 - e2 * s * s) ** 1.5
        a, b = ((r["x1"] - r["x0"]) / east, (r["y1"] - r["y0"]) / east), ((r["x2"] - r["x0"]) / north, (r["y2"] - r["y0"]) / north)
        assert abs(math.hypot(*a) - math.hypot(*b)) < 1e-4 * math.hypot(*a) and abs(a[0] * b[0] + a[1] * b[1]) < 1e-4 * math.hypot(*a) ** 2


def test_warp_from_utm(spark):
    src = GridSpec.square("EPSG:32629", 480_000.0, 4_300_000.0, 10_000.0, 8, 6)
    cells = spark.createDataFrame([(r, c, float(r * 8 + c)) for r in range(6) for c in range(8)], "row int, col int, value double")
    got, grid = W.to_mollweide(cells, src, 2000.0)
    values = {r["value"] for r in got.where("value is not null").select("value").distinct().collect()}
    assert grid.crs == "ESRI:54009" and values == {float(i) for i in range(48)}
    with pytest.raises(ValueError, match="2056"):
        W.to_mollweide(cells, GridSpec.square("EPSG:2056", 0.0, 0.0, 1.0, 2, 2), 1.0)
    laea, _ = W.to_mollweide(cells, GridSpec.square("EPSG:3035", 2_700_000.0, 2_000_000.0, 10_000.0, 8, 6), 2000.0)
    assert laea.select("value").distinct().count() == 48


def test_features_from_tm06(spark):
    x = F.lit(0.0)
    shape = F.struct(F.lit("Polygon").alias("type"), P.rectangle(x, F.lit(0.0), F.lit(1000.0), F.lit(1000.0)).alias("polys"))
    f = spark.range(2).select(F.when(F.col("id") == 0, "EPSG:3763").otherwise("EPSG:9999").alias("crs"), shape.alias("geometry"))
    got = {r["crs"]: r["area"] for r in V.crs_to_mollweide(f, projected=("EPSG:3763",)).select("crs", P.area(F.col("geometry.polys")).alias("area")).collect()}
    assert got["EPSG:9999"] == 1e6 and abs(got["ESRI:54009"] - 1e6) < 1e4  # Mollweide keeps areas, up to the sphere


def test_dissolved_parts(spark):
    box = lambda x, y, w, h: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]
    ring = lambda r: "array(" + ", ".join(f"struct(double({x}) as x, double({y}) as y)" for x, y in r) + ")"
    poly = lambda p: "array(" + ", ".join(map(ring, p)) + ")"
    parts = [("a", box(0, 0, 1, 1)), ("a", box(1, 0, 1, 1)), ("a", box(1, 0, 1, 1)), ("a", [box(5, 0, 1, 1)[0][::-1]]), ("b", [*box(0, 0, 5, 5), box(1, 1, 3, 3)[0]]), ("b", box(2, 2, 1, 1)), ("c", box(0, 0, 1, 1)), ("c", box(1, 1, 1, 1))]
    rows = " union all ".join(f"select '{k}' as k, named_struct('type', 'Polygon', 'polys', array({poly(p)})) as geometry" for k, p in parts)
    d = V.dissolve_coverage(spark.sql(rows), ["k"])
    got = {r["k"]: (r["type"], r["n"], r["rings"], r["area"]) for r in d.select("k", "geometry.type", F.size("geometry.polys").alias("n"), F.size(F.flatten("geometry.polys")).alias("rings"), P.area(F.col("geometry.polys")).alias("area")).collect()}
    assert got == {"a": ("MultiPolygon", 2, 2, 3.0), "b": ("MultiPolygon", 2, 3, 17.0), "c": ("MultiPolygon", 2, 2, 2.0)}
