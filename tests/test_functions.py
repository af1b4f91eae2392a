from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from terracell.functions import clean, geometry, mollweide, text
from terracell.model import GridSpec


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def values(spark, data, kind, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_missing_value_rules(spark):
    nan, inf = float("nan"), float("inf")
    assert values(spark, [1.0, 1e20, 9.96921e36, nan, None], "double", clean.mask_fill) == [1.0, None, None, None, None]
    assert values(spark, [-100.0, -100.0001, nan, None], "double", clean.mask_low) == [-100.0, None, None, None]
    got = values(spark, [-3.0, -2.0, -1.5, 0.0, 254.0, -9999.0, nan, inf, None], "double", clean.lights_log)
    assert got[:2] == [None, None] and got[5:] == [None] * 4
    assert got[2:5] == pytest.approx([math.log(0.5), math.log(2), math.log(256)])


def test_source_nodata_is_data_unless_named(spark):
    assert values(spark, [255.0], "double", clean.lights_log)[0] == pytest.approx(math.log(257))
    assert values(spark, [255.0], "double", lambda v: clean.lights_log(v, source_nodata=255.0)) == [None]


def test_leap_february(spark):
    r = one(spark, *[clean.monthly_total(F.lit(1.0), F.lit(d).cast("timestamp_ntz")) for d in ("2011-02-10", "2012-02-10")])
    assert (r[0], r[1]) == (28 * 86400.0, 29 * 86400.0)


def test_half_to_even(spark):
    assert values(spark, [0.5, 1.5, 2.5, -0.5], "double", clean.rint_long) == [0, 2, 2, 0]


@pytest.mark.parametrize("given, wanted", [
    ("1,5", 1.5), (" 1 234,5 ", 1234.5), ("1 234,5", 1234.5), ("1.234,5", None), ("", None), ("nan", None), ("None", None), ("abc", None), ("1d", None), ("1e3", 1000.0),
    ("inf", math.inf), ("-Infinity", -math.inf), ("+,5", 0.5), ("1_000", None), (None, None),
])
def test_decimal_comma(spark, given, wanted):
    assert values(spark, [given], "string", text.decimal_comma) == [wanted]


def test_zero_fill(spark):
    assert values(spark, ["10103", "-5", "+7", "1234567", "", None], "string", lambda v: text.zfill(v, 6)) == ["010103", "-00005", "+00007", "1234567", "000000", None]


def test_names(spark):
    assert values(spark, ["Açores é 1/2", " a\tb ", "x" * 200], "string", text.safe_filename) == ["Açores_é_1_2", "a_b", "x" * 150]
    assert values(spark, ["a1999_2011.nc", "none", "18000"], "string", text.year_in_name) == [1999, None, None]
    r = values(spark, ["V5.201102-201103_CROPPED.NC"], "string", text.month_of_name)[0]
    assert (r["year"], r["month"]) == (2011, 2)
    with pytest.raises(Exception, match="no year and month"):
        values(spark, ["other.nc"], "string", text.month_of_name)
    assert values(spark, ["/a/b.c.tif", "b", ".x"], "string", text.stem) == ["b.c", "b", ".x"]
    assert values(spark, ["  x\t"], "string", text.strip) == ["x"]


def test_wkt_defaults(spark):
    wkt = 'PARAM_MT["Affine",PARAMETER["elt_0_0", 0.1],PARAMETER["elt_0_2", -9.5],PARAMETER["elt_1_1", -0.1],PARAMETER["elt_1_2", 42]]'
    assert values(spark, [wkt], "string", text.affine_of_wkt) == [[0.1, 0.0, -9.5, 0.0, -0.1, 42.0]]


def test_mollweide_points(spark):
    pts = [(0.0, 0.0), (-8.0, 39.5), (-25.5, 37.7), (12.0, 90.0), (12.0, -90.0), (180.0, 10.0), (-180.0, 80.0)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    x, y = mollweide.forward(F.col("lon"), F.col("lat"))
    df = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = mollweide.inverse(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        # The series of Newton steps converges slowly towards the poles.
        assert r["lat2"] is None or abs(r["lat"] - r["lat2"]) < 1e-4
        if abs(r["lat"]) < 85 and abs(r["lon"]) < 180:
            assert abs(r["lon"] - r["lon2"]) < 1e-7 and abs(r["lat"] - r["lat2"]) < 1e-7
    out = one(spark, *mollweide.inverse(F.lit(0.0), F.lit(9.1e6)), *mollweide.inverse(F.lit(1.9e7), F.lit(0.0)), *mollweide.forward(F.lit(181.0), F.lit(0.0)))
    assert list(out) == [None] * 6


@pytest.mark.parametrize("crs, wanted", [("ESRI:54009", True), ("+proj=moll +lon_0=0", True), ('PROJCS["World_Mollweide"]', True), ("EPSG:4326", False), (None, False)])
def test_is_mollweide(spark, crs, wanted):
    assert values(spark, [crs], "string", mollweide.is_mollweide) == [wanted]
    assert mollweide.is_mollweide_name(crs) is wanted


def test_polygon_with_hole(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in p])
    polys = F.array(F.array(ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))))
    at = lambda x, y: geometry.contains(polys, F.lit(x), F.lit(y))
    r = one(spark, geometry.area(polys), at(0.5, 0.5), at(2.0, 2.0), at(5.0, 2.0), at(3.5, 2.0))
    assert list(r) == [12.0, True, False, False, True]


def test_shipped_envelope(spark):
    xs, ys = (-31.268814767149358, -6.189159307482949), (30.028778278100123, 42.154311127409436)
    m = one(spark, geometry.envelope_metrics(geometry.rectangle(F.lit(xs[0]), F.lit(ys[0]), F.lit(xs[1]), F.lit(ys[1]))).alias("m"))["m"]
    assert [round(v, 6) for v in m] == [25.079655, 12.125533, 304.104186, 74.410377]


def test_grid_spec():
    g = GridSpec("EPSG:4326", (0.5, 0.0, -10.0, 0.0, -0.25, 45.0), 4, 8)
    assert g.cell_size == 0.25 and g.bounds == (-10.0, 43.0, -8.0, 45.0) and g.resolution == "0.5 x 0.25"
    assert GridSpec.of(g.to_dict()) == g
    for bad in (("", (1, 0, 0, 0, 1, 0), 1, 1), ("x", (0, 0, 0, 0, 1, 0), 1, 1), ("x", (1, 0, 0, 0, 1, 0), 0, 1)):
        with pytest.raises(ValueError):
            GridSpec(*bad)
