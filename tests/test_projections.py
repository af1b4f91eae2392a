from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from terracell.functions import projections as J
from terracell.model import GridSpec
from terracell.operators import grid as G
from terracell.operators import resample as R
from terracell.operators import vector

GREENWICH = 'PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]'
CLARKE = f'GEOGCS["c",DATUM["c",SPHEROID["Clarke 1866",6378206.4,294.978698213898]],{GREENWICH}]'
AIRY = f'GEOGCS["a",DATUM["a",SPHEROID["Airy 1830",6377563.396,299.3249646]],{GREENWICH}]'
KRASSOWSKY = f'GEOGCS["k",DATUM["k",SPHEROID["Krassowsky 1940",6378245,298.3]],{GREENWICH}]'
WGS = f'GEOGCS["w",DATUM["w",SPHEROID["WGS 84",6378137,298.257223563]],{GREENWICH}]'
METRE = 'UNIT["metre",1]'


def projcs(base, method, unit=METRE, **parameters):
    p = ",".join(f'PARAMETER["{k}",{v!r}]' for k, v in parameters.items())
    return f'PROJCS["x",{base},PROJECTION["{method}"],{p},{unit}]'


FOOT = 0.304800609601219
#: Worked examples of published guides: system, longitude, latitude, easting, northing (fixed values).
EXAMPLES = [
    ("EPSG:3035", 5.0, 50.0, 3962799.45, 2999718.85),
    (projcs(AIRY, "Transverse_Mercator", latitude_of_origin=49.0, central_meridian=-2.0, scale_factor=0.9996012717, false_easting=400000.0, false_northing=-100000.0), 0.5, 50.5, 577274.99, 69740.50),
    (projcs(CLARKE, "Lambert_Conformal_Conic_2SP", f'UNIT["US survey foot",{FOOT}]', latitude_of_origin=27 + 5 / 6, central_meridian=-99.0, standard_parallel_1=28 + 23 / 60, standard_parallel_2=30 + 17 / 60, false_easting=2000000.0, false_northing=0.0), -96.0, 28.5, 2963503.91, 254759.80),
    (projcs(CLARKE, "Albers_Conic_Equal_Area", latitude_of_center=23.0, longitude_of_center=-96.0, standard_parallel_1=29.5, standard_parallel_2=45.5, false_easting=0.0, false_northing=0.0), -75.0, 35.0, 1885472.7, 1535925.0),
    (projcs(CLARKE, "Cylindrical_Equal_Area", standard_parallel_1=5.0, central_meridian=-75.0, false_easting=0.0, false_northing=0.0), -78.0, 5.0, -332699.8, 554248.5),
    (projcs(KRASSOWSKY, "Mercator_2SP", standard_parallel_1=42.0, central_meridian=51.0, false_easting=0.0, false_northing=0.0), 53.0, 53.0, 165704.29, 5171848.07),
    (projcs(WGS, "Polar_Stereographic", latitude_of_origin=90.0, central_meridian=0.0, scale_factor=0.994, false_easting=2000000.0, false_northing=2000000.0), 44.0, 73.0, 3320416.75, 632668.43),
    ("EPSG:3857", -100.33333333333333, 24.381786944444446, -11169055.58, 2800000.00),
]
CODES = ["EPSG:3035", "EPSG:3034", "EPSG:3763", "EPSG:27493", "EPSG:3857", "EPSG:6933", "EPSG:3413", "ESRI:54009", "EPSG:32629", "EPSG:25829", "EPSG:4087", "+proj=sinu +R=6371007.181 +units=m"]


@pytest.mark.parametrize("k", range(len(EXAMPLES)))
def test_published_examples(spark, k):
    name, lon, lat, east, north = EXAMPLES[k]
    df = spark.createDataFrame([(lon, lat)], "x double, y double")
    r = J.on_frame(df, J.crs(name).forward(), [("x", "y")]).first()
    assert r["x"] == pytest.approx(east, abs=0.06) and r["y"] == pytest.approx(north, abs=0.06)


@pytest.mark.parametrize("name", [*CODES, EXAMPLES[2][0], EXAMPLES[3][0]])
def test_round_trips_below_a_millimetre(spark, name):
    d = spark.range(600).select((F.col("id") % 30 - 20.0).alias("lon"), (F.floor(F.col("id") / 30) * 2.0 + 24.3).alias("lat"))
    if "survey" in name or "Albers" in name:
        d = d.withColumn("lon", F.col("lon") - 90)
    q = J.on_frame(d.select("*", F.col("lon").alias("x"), F.col("lat").alias("y")), J.crs(name).forward(), [("x", "y")])
    back = J.on_frame(q, J.crs(name).inverse(), [("x", "y")])
    m = back.agg(F.max(F.abs(F.col("x") - F.col("lon"))), F.max(F.abs(F.col("y") - F.col("lat"))), F.count("x")).first()
    assert m[2] == 600 and max(m[0], m[1]) * 111_320 < 1e-3
    x, _ = J.on_columns(J.crs(name).forward(), F.col("lon"), F.col("lat"))
    assert q.select(F.max(F.abs(x - F.col("x")))).first()[0] < 1e-6


def test_datum_shift(spark):
    """Datum 73 differs from WGS84 by the length of its translation, within what height hides."""
    c = J.Crs(J.INTERNATIONAL, None, {}, (-223.237, 110.193, 36.649))
    df = spark.createDataFrame([(-8.0, 39.5)], "x double, y double")
    r = J.on_frame(df, c.forward(), [("x", "y")]).first()
    moved = math.hypot((r["x"] + 8) * 111_320 * math.cos(math.radians(39.5)), (r["y"] - 39.5) * 111_000)
    assert 50 < moved < 260
    back = J.on_frame(J.on_frame(df, c.forward(), [("x", "y")]), c.inverse(), [("x", "y")]).first()
    assert back["x"] == pytest.approx(-8.0, abs=1e-10) and back["y"] == pytest.approx(39.5, abs=1e-10)


def test_wkt_versions():
    two = """PROJCRS["ETRS89-extended / LAEA Europe",BASEGEOGCRS["ETRS89",DATUM["European Terrestrial Reference System 1989",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],
      PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],CONVERSION["Europe Equal Area 2001",METHOD["Lambert Azimuthal Equal Area",ID["EPSG",9820]],
      PARAMETER["Latitude of natural origin",52,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of natural origin",10,ANGLEUNIT["degree",0.0174532925199433]],
      PARAMETER["False easting",4321000,LENGTHUNIT["metre",1]],PARAMETER["False northing",3210000,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["northing (Y)",north,ORDER[1],LENGTHUNIT["metre",1]],
      AXIS["easting (X)",east,ORDER[2],LENGTHUNIT["metre",1]],ID["EPSG",3035]]"""
    a, b = J.crs(two), J.crs("EPSG:3035")
    assert (a.ellipsoid, a.parameters, a.unit) == (b.ellipsoid, b.parameters, 1.0)
    assert J.crs(WGS).method is None and J.crs(f'COMPD_CS["both",{projcs(WGS, "Mollweide", central_meridian=0.0)},VERT_CS["h",VERT_DATUM["h",2005]]]').method == "mollweide"
    assert J.crs(WGS.replace("]],PRIMEM", '],TOWGS84[1,2,3,0,0,0,0]],PRIMEM')).shift == (1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0)
    for bad in ("EPSG:1", "", 'GEOGCS["no ellipsoid"]', "EPSG:32661"):
        with pytest.raises(ValueError):
            J.crs(bad)
    with pytest.raises(ValueError, match="not supported"):
        J.crs(projcs(WGS, "Bonne")).forward()


def test_nothing_outside(spark):
    df = spark.createDataFrame([(0.0, 95.0), (None, 1.0), (190.0, 10.0)], "x double, y double")
    assert [r["x"] for r in J.on_frame(df.limit(2), J.crs("EPSG:3035").forward(), [("x", "y")]).collect()] == [None, None]
    far = spark.createDataFrame([(3e7, 0.0), (0.0, 9e6)], "x double, y double")
    assert [r["x"] for r in J.on_frame(far, J.crs("+proj=sinu +R=6371007.181").inverse(), [("x", "y")]).collect()][0] is None


def raster(spark, grid, value=lambda r, c: 1.0 + (r * 7 + c * 3) % 11):
    return spark.createDataFrame([(r, c, float(value(r, c))) for r in range(grid.height) for c in range(grid.width)], "row int, col int, value double")


SRC = GridSpec.square("EPSG:4326", -10.0, 43.0, 0.5, 14, 12)


@pytest.mark.parametrize("target", [
    GridSpec.square("ESRI:54009", -1_100_000.0, 5_300_000.0, 83_000.0, 12, 12), GridSpec.square("EPSG:3035", 2_400_000.0, 2_600_000.0, 31_000.0, 40, 40),
    GridSpec("EPSG:3763", (40_000.0, 9_000.0, -600_000.0, 7_000.0, -40_000.0, 550_000.0), 40, 40),
])
def test_totals_are_conserved(spark, target):
    cells = raster(spark, SRC)
    total = cells.agg(F.sum("value")).first()[0]
    counts = R.regrid_counts(cells, SRC, target)
    assert R._by_overlap(cells, SRC, target, "sum", []).agg(F.sum("value")).first()[0] == pytest.approx(total, rel=1e-9)
    assert counts.agg(F.sum("value")).first()[0] == pytest.approx(total, rel=1e-5)
    # A field of one value stays that, in every method.
    flat = raster(spark, SRC, lambda r, c: 4.0)
    for how in ("average", "mode", "med", "nearest", "bilinear") if target.crs == "EPSG:3763" else ("average", "max"):
        got = R.regrid(flat, SRC, target, how).agg(F.min("value"), F.max("value"), F.count("*")).first()
        assert got[0] == pytest.approx(4.0) and got[1] == pytest.approx(4.0) and got[2] > 50
    # Areas: a target cell that is covered wholly has area 1.
    area = R.warped_overlaps(cells, SRC, target, []).groupBy("row", "col").agg(F.sum("area").alias("a"))
    assert area.agg(F.max("a")).first()[0] == pytest.approx(1.0, abs=1e-6)
    average = R.regrid(cells, SRC, target, "average").agg(F.min("value"), F.max("value")).first()
    assert 1.0 - 1e-9 <= average[0] <= average[1] <= 11.0 + 1e-9


def test_rotated_grids_overlap_exactly(spark):
    """Cells turned by 45 degrees: the areas are those of triangles and trapezoids."""
    src = GridSpec("LOCAL", (1.0, 1.0, 0.0, 1.0, -1.0, 0.0), 1, 1)  # a square with corners (0, 0), (1, 1), (2, 0), (1, -1)
    dst = GridSpec.square("LOCAL", 0.0, 1.0, 1.0, 2, 2)
    got = {(r["row"], r["col"]): (r["area"], r["w"]) for r in R.overlaps(raster(spark, src), src, dst, []).collect()}
    assert got == {k: (pytest.approx(0.5), pytest.approx(0.25)) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    shifted = GridSpec.square("LOCAL", 0.5, 0.75, 0.5, 2, 1)
    assert {r["col"]: r["area"] for r in R.overlaps(raster(spark, src), src, shifted, []).collect()} == {0: pytest.approx(1 - 0.125), 1: pytest.approx(1 - 0.125)}


def test_same_grid_by_both_ways(spark):
    dst = GridSpec.square("EPSG:4326", -10.3, 43.2, 0.7, 12, 10)
    cells = raster(spark, SRC)
    key = lambda df: {(r["row"], r["col"], r["value"]): r["w"] for r in df.collect()}
    a, b = key(R.overlaps(cells, SRC, dst, []).where("w > 1e-9")), key(R.warped_overlaps(cells, SRC, dst, []))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=1e-7) for k in a)


def test_features_between_systems(spark):
    shape = {"type": "Polygon", "polys": [[[{"x": -9.0, "y": 39.0}, {"x": -8.0, "y": 39.0}, {"x": -8.0, "y": 40.0}, {"x": -9.0, "y": 39.0}]]]}
    df = spark.createDataFrame([("EPSG:4326", shape), (None, shape), ("EPSG:3763", None)], "crs string, geometry struct<type:string,polys:array<array<array<struct<x:double,y:double>>>>>")
    there = vector.to_crs(df, "EPSG:3035", ["EPSG:4326"])
    rows = there.collect()
    assert [r["crs"] for r in rows] == ["EPSG:3035", None, "EPSG:3763"] and rows[1]["geometry"]["polys"][0][0][0]["x"] == -9.0
    assert 2_600_000 < rows[0]["geometry"]["polys"][0][0][0]["x"] < 2_800_000
    back = vector.to_crs(there, "EPSG:4326", ["EPSG:3035"]).first()["geometry"]["polys"][0][0]
    assert [p["x"] for p in back] == pytest.approx([-9.0, -8.0, -8.0, -9.0], abs=1e-9)
    assert vector.to_crs(df, "EPSG:3035", []).count() == 3
    assert G.cells(spark, SRC).count() == 168
