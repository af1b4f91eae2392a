from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import geometry as P
from terracell.model import VAR_TYPES, GridSpec
from terracell.operators import climate, grid, keys, reproject, resample, temporal, vector
from terracell.plans import align, curate, emissions, guards, indicator_map
from terracell.plans import manifest as M

LOCAL = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def months(spark, rows):
    return spark.createDataFrame(rows, "cell int, year int, month int, value double")


def test_constant_series_has_no_delta(spark):
    r = temporal.seasonal_products(months(spark, [(1, y, m, 7.0) for y in (2010, 2011) for m in range(1, 13)]), ["cell"]).first()
    assert (r["delta"], r["average"], r["months"], r["years"]) == (0.0, 7.0, 24, 2)


def test_gaps_in_seasons(spark):
    rows = [(1, 2010, m, float(m)) for m in range(1, 13)] + [(1, 2011, m, 5.0) for m in range(3, 13)] + [(1, 2012, m, 9.0) for m in (1, 2)] + [(2, 2010, m, None) for m in range(1, 13)]
    got = {r["cell"]: r for r in temporal.seasonal_products(months(spark, rows), ["cell"]).collect()}
    assert got[1]["delta"] == pytest.approx(1.5 - 7.5) and got[1]["years"] == 1
    assert got[1]["average"] == pytest.approx((78 + 50 + 18) / 24)
    assert got[2]["delta"] is None and got[2]["average"] is None


def test_average_is_not_balanced_by_year(spark):
    rows = [(1, 2010, m, 1.0) for m in range(1, 13)] + [(1, 2011, m, 8.0) for m in (1, 2)]
    assert temporal.seasonal_products(months(spark, rows), ["cell"]).first()["average"] == pytest.approx(2.0)


def test_one_exchange_serves_both_levels(spark):
    plan = temporal.seasonal_products(months(spark, [(1, 2010, 1, 1.0)]), ["cell"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_strict_thresholds(spark):
    d = spark.createDataFrame([(1, 2010, v) for v in (17.999, 18.0, 25.0, 25.001, None)] + [(2, 2010, None)], "cell int, year int, value double")
    got = {r["cell"]: r for r in climate.yearly_indices(d, ["cell"]).collect()}
    assert (got[1]["hdd_18"], got[1]["cdd_25"]) == (1, 1)
    assert (got[2]["hdd_18"], got[2]["cdd_25"], got[2]["extreme_heat"]) == (None, None, None)


@pytest.mark.parametrize("days, heat, cold", [(5, None, None), (6, 1.0, 6.0), (9, 2.5, 7.5), (10, 3.0, 8.0), (11, 4.0, 8.0)])
def test_trimmed_extremes(spark, days, heat, cold):
    d = spark.createDataFrame([(1, 2010, float(i)) for i in range(1, days + 1)], "cell int, year int, value double")
    r = climate.yearly_indices(d, ["cell"]).first()
    assert (r["extreme_heat"], r["extreme_cold"]) == (heat, cold)
    w = climate.ranked_extremes(d, ["cell"]).first()
    assert (w["extreme_heat"], w["extreme_cold"]) == (heat, cold)


def cells(spark, rows):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "row int, col int, value double")


def as_dict(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def square(n, size):
    return GridSpec("LOCAL", (size, 0.0, 0.0, 0.0, size, 0.0), n, n)


@pytest.mark.parametrize("how", ["average", "mode", "max", "min", "med", "q1", "q3", "nearest", "bilinear", "cubic"])
def test_constants_survive(spark, how):
    src = cells(spark, [[3.0] * 10 for _ in range(10)])
    got = as_dict(resample.regrid(src, square(10, 1.0), square(4, 2.5), how))
    assert len(got) == 16 and all(v == pytest.approx(3.0) for v in got.values())


def test_mode_ties_take_the_smallest(spark):
    assert as_dict(resample.regrid(cells(spark, [[2.0, 1.0], [1.0, 2.0]]), square(2, 1.0), square(1, 2.0), "mode")) == {(0, 0): 1.0}


def test_counts_at_the_edge(spark):
    src = cells(spark, [[1.0] * 3 for _ in range(3)])
    default = as_dict(resample.regrid_counts(src, square(3, 1.0), square(2, 2.0)))
    exact = as_dict(resample.regrid_counts(src, square(3, 1.0), square(2, 2.0), exact=True))
    assert sum(exact.values()) == 9.0 and sum(default.values()) == 16.0


def test_counts_skip_missing(spark):
    src = cells(spark, [[None, 2.0], [2.0, 2.0]])
    assert as_dict(resample.regrid_counts(src, square(2, 1.0), square(1, 2.0))) == {(0, 0): 8.0}
    assert as_dict(resample.regrid_counts(src, square(2, 1.0), square(1, 2.0), exact=True)) == {(0, 0): 6.0}


def test_fill_gives_every_target_cell(spark):
    got = as_dict(resample.regrid(cells(spark, [[1.0]]), square(1, 1.0), square(2, 1.0), "nearest", fill=0.0))
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.0}


def test_overlap_has_no_nested_loop(spark):
    plan = resample.regrid(cells(spark, [[1.0]]), square(1, 1.0), square(2, 2.5), "average")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_resampling_guards(spark):
    with pytest.raises(ValueError, match="unknown resampling"):
        resample.method("lanczos")
    with pytest.raises(ValueError, match="CRS"):
        resample.regrid(cells(spark, [[1.0]]), square(1, 1.0), GridSpec("EPSG:4326", LOCAL, 1, 1), "average")
    with pytest.raises(ValueError):
        align.resampling_for("ratio", True)


@pytest.mark.parametrize("sizes, prefer, label", [((1.0, 2.0), "A_to_B", "A"), ((2.0, 1.0), "A_to_B", "B"), ((1.0, 1.0), "A_to_B", "A"), ((1.0, 1.0 + 1e-7), "B_to_A", "B")])
@pytest.mark.parametrize("kind", VAR_TYPES)
def test_alignment_direction(spark, sizes, prefer, label, kind):
    a, b = cells(spark, [[1.0, 1.0], [1.0, 1.0]]), cells(spark, [[1.0, 1.0], [1.0, 1.0]])
    out, moved = align.align_two(a, square(2, sizes[0]), kind, b, square(2, sizes[1]), kind, prefer)
    assert moved == label and out.count() >= 1


def test_catalog_alignment_sums_counts(spark):
    a = cells(spark, [[1.0, 2.0], [3.0, 4.0]])
    out, label = align.align_two_by_catalog(a, square(2, 1.0), "count", cells(spark, [[0.0]]), square(1, 2.0), "count")
    assert label == "A" and as_dict(out) == {(0, 0): 10.0}


def test_cell_polygons_cap(spark):
    assert grid.cell_polygons(spark, square(3, 1.0), max_cells=8) is None
    assert grid.cell_polygons(spark, square(3, 1.0)).count() == 9


def test_warp_covers_the_source(spark):
    src = GridSpec.square("EPSG:4326", -10.0, 43.0, 1.0, 6, 6)
    out, dst = reproject.to_mollweide(cells(spark, [[5.0] * 6 for _ in range(6)]), src, 50_000.0)
    v = out.agg(F.count("*"), F.min("value"), F.max("value")).first()
    assert dst.crs == "ESRI:54009" and v[0] > 50 and (v[1], v[2]) == (5.0, 5.0)


def test_keys(spark):
    t = spark.createDataFrame([("", "1"), ("nan", "2"), ("NaN", "3"), ("NA", "4"), ("null", "5"), ("-", "6"), (" 12 ", "7,5"), ("12", "8"), (None, "9")], "ID string, v string")
    got = keys.indicators(t)
    assert sorted(r["ID"] for r in got.collect()) == ["-", "12", "12"]
    f = spark.createDataFrame([("0012",), ("7",)], "dicofre string")
    a, b = keys.pad_together((f, "dicofre"), (got, "ID"))
    joined = keys.join_values(a, b).collect()
    assert sorted((r["dicofre"], r["v"]) for r in joined if r["v"]) == [("0012", 7.5), ("0012", 8.0)] and len(joined) == 3
    with pytest.raises(ValueError):
        keys.value_columns(f, "dicofre")


def poly(*rings):
    return {"type": "Polygon", "polys": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]}


SHAPES = "k string, geometry struct<type:string,polys:array<array<array<struct<x:double,y:double>>>>>"
BOX = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]


def test_dissolve(spark):
    d = spark.createDataFrame([("a", poly(BOX(0, 0, 1))), ("a", poly(BOX(5, 5, 1))), ("b", poly(BOX(0, 0, 1))), ("c", None)], SHAPES)
    got = {r["k"]: len(r["geometry"]["polys"]) for r in vector.dissolve(d, "k").collect()}
    assert got == {"a": 2, "b": 1}
    with pytest.raises(Exception, match="parts overlap"):
        vector.dissolve(spark.createDataFrame([("a", poly(BOX(0, 0, 2))), ("a", poly(BOX(1, 1, 2)))], SHAPES), "k").collect()


def test_sweep_finds_overlaps():
    rng = np.random.default_rng(1)
    found = []
    for _ in range(3000):
        n = int(rng.integers(1, 7))
        low = rng.integers(0, 9, (2, n)).astype(float)
        high = low + rng.integers(0, 4, (2, n))
        high[rng.random((2, n)) < 0.02] = math.nan
        less = lambda a, b: a < b or (math.isnan(b) and not math.isnan(a))
        pairs = ((i, j) for i in range(n) for j in range(i))
        want = any(all(less(low[d, i], high[d, j]) and less(low[d, j], high[d, i]) for d in (0, 1)) for i, j in pairs)
        assert vector.overlapping(low[0], low[1], high[0], high[1]) == want, (low, high)
        found.append(want)
    assert 500 < sum(found) < 2500


def _boxes(spark, rows):
    d = spark.createDataFrame(rows, "k int, x double, y double, w double, h double")
    return d.select("k", F.struct(F.lit("Polygon").alias("type"), P.rectangle(F.col("x"), F.col("y"), F.expr("x + w"), F.expr("y + h")).alias("polys")).alias("geometry"))


def test_dissolve_in_strips(spark):
    tiles = [(k, float(x), float(y), 1.0, 1.0) for k in (1, None) for x in range(12) for y in range(25) if (x, y) != (5, 20)]
    columns = [(2, float(x), 0.0, 1.0, 100.0) for x in range(60)]
    size = lambda rows: {r["k"]: r["n"] for r in vector.dissolve(_boxes(spark, rows), "k", strip_parts=7).select("k", F.size("geometry.polys").alias("n")).collect()}
    assert size([*tiles, *columns]) == {1: 299, None: 299, 2: 60}
    assert size([*tiles, *columns, (1, 5.0, 20.0, 1.0, 1.0), (3, 0.0, 0.0, 20.0, 20.0)]) == {1: 300, None: 299, 2: 60, 3: 1}
    for extra in [(1, 5.0, 20.0, 1.0, 1.125), (1, 5.5, 19.0, 0.0, 2.0), (2, 30.5, 99.0, 0.25, 5.0), (2, -5.0, 50.0, 200.0, 0.0), (2, 3.0, 0.0, 1.0, 100.0)]:
        with pytest.raises(Exception, match=f"parts overlap for key {extra[0]}"):
            size([*tiles, *columns, extra])
    with pytest.raises(Exception):
        size([*tiles, (None, 5.0, 20.0, 1.5, 1.0)])


def test_dissolve_of_many_parts(spark):
    k = F.col("id").cast("double")
    f = spark.range(4000).select(F.lit(1).alias("k"), F.struct(F.lit("Polygon").alias("type"), P.rectangle(k % 60, F.floor(k / 60), k % 60 + 1, F.floor(k / 60) + 1).alias("polys")).alias("geometry"))
    began = time.perf_counter()
    assert vector.dissolve(f, "k").select(F.size("geometry.polys")).first()[0] == 4000
    assert time.perf_counter() - began < 60  # all pairs of envelopes take minutes


def test_mask_is_idempotent(spark):
    f = spark.createDataFrame([("a", poly(BOX(1, 1, 2)))], SHAPES)
    g = square(5, 1.0)
    m = vector.mask_cells(f, g, bin_cells=2)
    c = cells(spark, [[1.0] * 5 for _ in range(5)])
    once = vector.apply_mask(c, m)
    assert as_dict(once) == as_dict(vector.apply_mask(once, m)) and once.count() == 4
    kept = vector.apply_mask(c, m, keep_rows=True)
    assert kept.count() == 25 and kept.where("value is null").count() == 21


@pytest.mark.parametrize("up", [True, False])
def test_scan_lines_agree_with_point_tests(spark, up):
    import random

    rng = random.Random(3)
    ring = lambda n: [(x, y) for x, y in [(rng.choice([rng.uniform(-3, 15), rng.randrange(-2, 14) + 0.5]), rng.choice([rng.uniform(-3, 15), rng.randrange(-2, 14) + 0.5])) for _ in range(n)]]
    closed = lambda r: [*r, r[0]]
    rows = [("a", poly(closed(ring(n)), closed(ring(4)))) for n in (3, 4, 7, 30)] + [("b", poly(closed(ring(5)))), ("b", poly(closed(ring(5)))), ("c", None), ("d", poly(BOX(1.5, 1.5, 3)))]
    f = spark.createDataFrame(rows, SHAPES)
    g = GridSpec.square("LOCAL", 0.0, 12.0 if up else 0.0, 1.0, 12, 12, up=up)
    for carry in (None, "k"):
        fast, slow = vector.mask_cells(f, g, carry=carry), vector._mask_by_bins(f, g, "geometry", 4, carry)
        assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) and fast.count() > 20
    turned = GridSpec("LOCAL", (0.7, 0.7, -2.0, 0.7, -0.7, 6.0), 9, 9)
    assert vector.mask_cells(f, turned).count() > 5


def test_quantiles_from_sketches(spark):
    """With an accuracy beyond the number of cells they are the values of the exact ranks; with less, within the bound."""
    src, dst = square(60, 1.0), square(2, 30.0)
    c = cells(spark, [[float((r * 60 + k) * 7919 % 3607) for k in range(60)] for r in range(60)])
    for how, q in (("med", 0.5), ("q1", 0.25), ("q3", 0.75)):
        exact, loose = as_dict(resample.regrid(c, src, dst, how, accuracy=10_000)), as_dict(resample.regrid(c, src, dst, how, accuracy=20))
        rows = {}
        for r in c.collect():
            rows.setdefault((r["row"] // 30, r["col"] // 30), []).append(r["value"])
        for at, v in rows.items():
            v = sorted(v)
            assert exact[at] == v[math.ceil(q * len(v)) - 1]
            assert abs(v.index(loose[at]) - q * len(v)) <= len(v) / 20 + 1


def test_guards(spark):
    f = spark.createDataFrame([(2010, 1), (2010, 2), (2011, 1)], "year int, month int")
    assert guards.missing_years(f, 2010, 2012).collect()[0]["year"] == 2012
    with pytest.raises(ValueError, match="2011-2"):
        guards.require_none(guards.missing_months(f, 2010, 2011), "months")
    with pytest.raises(ValueError, match="shapes"):
        guards.require_one_shape(spark.createDataFrame([("a", 0, 0), ("b", 1, 0)], "f string, row int, col int"), "f")


def test_variable_rules():
    assert emissions.choose_emission_variable({"crs": "string", "z": "float32", "a": "float32"}) == "z"
    assert emissions.choose_pm25_variable({"pm": "float32", "PM25": "float64", "x": "int16"}) == "PM25"
    assert emissions.choose_pm25_variable({"b": "float32", "a": "float32"}) == "b"
    with pytest.raises(ValueError):
        emissions.choose_pm25_variable({"a": "float32"}, "b")


def test_emissions_need_all_years(spark):
    from datetime import datetime

    c = spark.createDataFrame([(0, 0, datetime(y, m, 15), 1.0) for y in (2010, 2011) for m in range(1, 13)], "row int, col int, t timestamp_ntz, value double")
    with pytest.raises(ValueError, match="missing years: 2012"):
        emissions.emissions(c)
    r = emissions.emissions(c, 2010, 2011).first()
    assert r["delta"] < 0 and r["average"] == pytest.approx(365 / 12 * 86400, rel=1e-3)


def test_curation_actions(spark):
    cfg = curate.Config("/raw", "/out")
    raster = spark.createDataFrame([(1, 0, 0, 0.0), (2, 0, 0, 5.0), (1, 0, 1, -2.0)], "band int, row int, col int, value double")
    moll = GridSpec.square("ESRI:54009", 0.0, 0.0, 1000.0, 2, 1)
    layers = [curate.Layer("a.tif", "ntl", raster, moll), curate.Layer("b.tif", "other", raster, moll), curate.Layer("c.tif", "other", raster, GridSpec.square("EPSG:4326", 0.0, 1.0, 1.0, 2, 1))]
    out, entries, grids = curate.curate_all(layers, cfg, spark)
    what = {r["name"]: r["entry"]["general"]["action"] for r in entries.collect()}
    assert what == {"a.tif": "postprocessed_only", "b.tif": "copied", "c.tif": "reprojected"}
    ntl = {(r["band"], r["col"]): r["value"] for r in out.where("layer = 'a.tif'").collect()}
    assert ntl[1, 0] == pytest.approx(0.6931, abs=1e-4) and ntl[2, 0] == 5.0 and ntl[1, 1] is None
    assert grids["c.tif"].crs == "ESRI:54009"


def test_manifest_text(spark, tmp_path):
    none = F.lit(None).cast("string")
    e = spark.range(2).select(F.lit("NTL").alias("folder"), F.lit("á.tif").alias("name"), F.col("id").alias("seq"), M.entry(F.lit("á.tif"), none, none, F.when(F.col("id") == 0, "copied").otherwise("reprojected"), none, none, none, F.lit(None), none, none, F.array(F.lit("x"))).alias("entry"))
    docs = M.manifests(e)
    text = docs.select(M.to_text(F.col("manifest")).alias("t")).first()["t"]
    assert '"src_path" : null' in text and "á.tif" in text and text.count('"action"') == 1 and '"reprojected" : true' in text
    M.write(docs, str(tmp_path / "m"))
    corrupt = spark.createDataFrame([("{oops",), (None,), ("{}",)], "t string").select(F.size(M.from_text(F.col("t"))["files"]).alias("n"))
    assert [r["n"] for r in corrupt.collect()] == [0, 0, 0]


def test_indicator_map(spark):
    shapes = {"main": spark.createDataFrame([("10103", poly(BOX(0, 0, 1))), ("x", None)], SHAPES.replace("k string", "DICOFRE string")), "no key": spark.range(1).toDF("a")}
    table = spark.createDataFrame([("010103", "1,5")], "ID string, share string")
    r = indicator_map.indicator_map(shapes, table).collect()
    assert [(x["dicofre"], x["share"]) for x in r] == [("010103", 1.5)]
    _, warning = indicator_map.with_key(shapes)
    assert warning == "no dicofre in no key"
    assert indicator_map.split_layers(["/b/cont_aad_caop2016.shp", "/a/i.shp"]) == ("/b/cont_aad_caop2016.shp", ["/a/i.shp"])
