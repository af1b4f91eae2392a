from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell import streaming
from terracell.model import GridSpec
from terracell.sources import delimited, geojson, geotiff, listing, netcdf3, shapefile

GRID = GridSpec.square("EPSG:4326", -10.0, 45.0, 0.5, 300, 260)


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
@pytest.mark.parametrize("tiled, compress", [(True, True), (False, True), (True, False), (False, False)])
def test_tiff_round_trip(dtype, tiled, compress):
    bands = np.random.default_rng(1).integers(0, 200, (2, 260, 300)).astype(dtype)
    back, grid, nodata = geotiff.decode(geotiff.encode(bands, GRID, 7.0, compress, tiled))
    assert (back == bands).all() and grid == GRID and nodata == 7.0


def test_tiff_crs_names():
    g = GridSpec("ESRI:54009", (1000.0, 0.0, 5.0, 0.0, -1000.0, 9.0), 3, 2)
    _, back, nodata = geotiff.decode(geotiff.encode(np.zeros((1, 2, 3), "float32"), g))
    assert back == g and nodata is None
    with pytest.raises(ValueError):
        geotiff.decode(b"II*")


def test_tiff_cells(spark, tmp_path):
    a = np.array([[[1.0, -9999.0, np.nan], [4.0, 5.0, 6.0]]], "float32")
    (tmp_path / "NTL").mkdir()
    (tmp_path / "NTL" / "a.tif").write_bytes(geotiff.encode(a, GridSpec.square("ESRI:54009", 0.0, 0.0, 10.0, 3, 2), -9999.0))
    c = geotiff.read_cells(spark, str(tmp_path))
    assert c.count() == 6 and c.where("value is null").count() == 2 and c.agg(F.sum("value")).first()[0] == 16.0
    g = geotiff.read_grids(spark, str(tmp_path)).first()
    assert (g["crs"], g["width"], g["height"], g["bands"], g["nodata"], g["dtype"]) == ("ESRI:54009", 3, 2, 1, -9999.0, "float32")
    folder = listing.raster_folders(listing.listing(spark, str(tmp_path), recursive=True)).first()
    assert (folder["data_type"], folder["name"]) == ("NTL", "a.tif")
    out = str(tmp_path / "b.tif")
    grid = GridSpec.square("ESRI:54009", 0.0, 0.0, 10.0, 3, 2)
    assert geotiff.write_layer(c, grid, out) and not geotiff.write_layer(c, grid, out)
    back, _, _ = geotiff.decode(open(out, "rb").read())
    assert back[0, 0].tolist() == [1.0, -9999.0, -9999.0]
    geotiff.write_tiles(c.withColumn("layer", F.lit("x")), str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 6


def test_netcdf_round_trip(spark, tmp_path):
    res = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    res[0, 0, 0] = 9.96921e36
    v = {
        "time": netcdf3.Variable(("time",), np.array([15.0, 45.0]), {"units": "days since 2010-01-01 00:00:00", "calendar": "standard"}),
        "other": netcdf3.Variable(("time", "LAT", "lon"), res * 0), "res": netcdf3.Variable(("time", "LAT", "lon"), res, {"_FillValue": float(np.float32(9.96921e36)), "scale_factor": 2.0}),
    }
    (tmp_path / "e_2010.nc").write_bytes(netcdf3.encode(v))
    c = netcdf3.read_cells(spark, str(tmp_path))
    assert c.count() == 24 and c.where("value is null").count() == 1
    r = c.where("row = 2 and col = 3").orderBy("t").collect()
    assert [(x["t"], x["value"]) for x in r] == [(datetime(2010, 1, 16), 22.0), (datetime(2010, 2, 15), 46.0)]
    y = listing.yearly_files(listing.listing(spark, str(tmp_path)), 2010, 2012).first()
    assert y["year"] == 2010 and y["path"].endswith("e_2010.nc")
    with pytest.raises(ValueError, match="calendar"):
        netcdf3.times(netcdf3.Variable(("t",), np.zeros(1), {"units": "days since 2000-01-01", "calendar": "noleap"}))


def test_shapefile_round_trip(spark, tmp_path):
    box = lambda x, n: [(x, 0.0), (x, n), (x + n, n), (x + n, 0.0), (x, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    rows = [({"DICOFRE": "010103", "N": "é"}, [[box(0.0, 4.0), hole], [box(10.0, 1.0)]]), ({"DICOFRE": "020202", "N": ""}, None)]
    shp, dbf = shapefile.encode(rows)
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(dbf)
    f = {r["dicofre"]: r["geometry"] for r in shapefile.read_features(spark, str(tmp_path)).collect()}
    assert f["020202"] is None and f["010103"]["type"] == "MultiPolygon" and [len(p) for p in f["010103"]["polys"]] == [2, 1]
    other = shapefile.encode([({"NAME": "x"}, [[box(0.0, 1.0)]])])
    (tmp_path / "b.shp").write_bytes(other[0])
    (tmp_path / "b.dbf").write_bytes(other[1])
    assert shapefile.read_features(spark, str(tmp_path)).count() == 2


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    geoms = [{"type": "Polygon", "coordinates": [ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "Polygon", "coordinates": [ring]}]}, {"type": "Point", "coordinates": [1, 1]}, None]
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": [{"type": "Feature", "properties": {"dicofre": f"0{i}", "v": i + 0.5}, "geometry": g} for i, g in enumerate(geoms)]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    f = {r["dicofre"]: r for r in geojson.read_features(spark, str(tmp_path / "f.geojson"), "dicofre string, v double").collect()}
    n = {k: None if r["geometry"] is None or r["geometry"]["polys"] is None else len(r["geometry"]["polys"]) for k, r in f.items()}
    assert n == {"00": 1, "01": 2, "02": 1, "03": None, "04": None} and f["00"]["v"] == 0.5 and f["00"]["crs"] == "EPSG:4326"
    df = geojson.read_features(spark, str(tmp_path / "f.geojson"), "dicofre string, v double").where("dicofre < '02'")
    geojson.write_features(df, str(tmp_path / "out"))
    geojson.write_features(df.limit(0), str(tmp_path / "out"))
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(b["geometry"]["type"] for b in back) == ["MultiPolygon", "Polygon"] and all(b["type"] == "Feature" for b in back)


def test_delimited(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿ID;share;n\n010103;1,5;2\nnan;3;4\n 7 ;;abc\n", encoding="utf-8")
    got = sorted((r["ID"], r["share"], r["n"]) for r in delimited.read_indicators(spark, str(tmp_path / "t.csv")).collect())
    assert got == [("010103", 1.5, 2.0), ("7", None, None)]


def test_streamed_state(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double").coalesce(1).write.parquet(str(src))
    run = lambda: streaming.keep_running_means(spark.readStream.schema("k string, v double").parquet(str(src)), ["k"], "v", str(tmp_path / "state"), str(tmp_path / "cp"))
    q = run()
    q.processAllAvailable()
    q.stop()
    spark.createDataFrame([("a", 5.0)], "k string, v double").coalesce(1).write.mode("append").parquet(str(src))
    q = run()
    q.processAllAvailable()
    q.stop()
    got = {r["k"]: (r["total"], r["n"]) for r in spark.read.parquet(str(tmp_path / "state" / "version=1")).collect()}
    assert got == {"a": (9.0, 3), "b": (0.0, 0)}


def test_running_changes(spark, tmp_path):
    """State lives in Spark: the second batch only writes the key that it changed."""
    src, out = tmp_path / "in", tmp_path / "out"
    add = lambda *rows: spark.createDataFrame(rows, "k string, v double").coalesce(1).write.mode("append").parquet(str(src))
    add(("a", 1.0), ("a", 3.0), ("b", None), ("c", float("nan")), (None, 2.0))

    def run():
        q = streaming.keep_running_changes(spark.readStream.schema("k string, v double").parquet(str(src)), ["k"], "v", str(out), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()

    run()
    add(("a", 5.0))
    run()
    changes = spark.read.parquet(str(out))
    assert sorted((r["batch"], r["k"] or "") for r in changes.collect()) == [(0, ""), (0, "a"), (0, "b"), (0, "c"), (1, "a")]
    got = {r["k"]: (r["total"], r["n"], r["average"]) for r in streaming.latest(changes, ["k"]).collect()}
    assert got == {"a": (9.0, 3, 3.0), "b": (0.0, 0, None), "c": (0.0, 0, None), None: (2.0, 1, 2.0)}


def test_exports(spark, tmp_path):
    from terracell.sources import sinks

    rows = [("a", r, c, float(r * 4 + c)) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(rows, "layer string, row int, col int, value double")
    out = str(tmp_path / "export")
    assert sinks.export(df, out) and not sinks.export(df.limit(0), out)
    back = spark.read.parquet(out)
    assert back.count() == 16 and dict(back.dtypes)["value"] == "float"
    grid = GridSpec.square("LOCAL", 0.0, 0.0, 1.0, 4, 4)
    levels = str(tmp_path / "levels")
    assert sinks.export_with_overviews(df, grid, levels) == 3
    assert spark.read.parquet(f"{levels}/level=2").first()["value"] == 7.5


def lzw(data: bytes) -> bytes:
    """TIFF flavour of LZW: codes of growing width, the highest bit first."""
    table, out, width, held, bits = {bytes([i]): i for i in range(256)}, bytearray(), 9, 0, 0

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    last, nxt = b"", 258
    for b in data:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        put(table[last])
        table[last + bytes([b])] = nxt
        nxt += 1
        width = max(width, nxt.bit_length())
        if nxt == 4095:
            put(256)
            table, width, nxt = {bytes([i]): i for i in range(256)}, 9, 258
        last = bytes([b])
    if last:
        put(table[last])
    put(257)
    out.append(held << (8 - bits) & 255 if bits else 0)
    return bytes(out)


def test_lzw():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"ababababab" * 50, bytes(rng.integers(0, 256, 30_000, dtype=np.uint8)), bytes(rng.integers(0, 3, 200_000, dtype=np.uint8))):
        assert geotiff._unpack_lzw(lzw(data)) == data


def test_tiff_of_other_makers():
    """Strips with LZW and a predictor, made by patching a plain file's tags."""
    a = np.random.default_rng(3).normal(size=(1, 40, 30)).astype("<f4")
    plain = geotiff.encode(a, GridSpec.square("EPSG:4326", 0.0, 0.0, 1.0, 30, 40), compress=False, tiled=False)
    big = a[0].astype(">f4").view(np.uint8).reshape(40, 30, 4).transpose(0, 2, 1).reshape(40, 120)
    rows = np.concatenate([big[:, :1], np.diff(big.astype(np.int16), axis=1).astype(np.uint8)], axis=1)
    for predictor, raw in ((1, a.tobytes()), (3, rows.tobytes())):
        packed = lzw(raw)
        order, tags = geotiff._header(plain)
        head = geotiff._head(GridSpec.square("EPSG:4326", 0.0, 0.0, 1.0, 30, 40), 1, a.dtype, None, [len(packed)], [0], True, 40, False)
        at = head.index(b"\x03\x01\x03\x00\x01\x00\x00\x00\x08\x00")  # compression 8 becomes 5
        head = head[: at + 8] + b"\x05" + head[at + 9 :]
        at = head.index(b"\x06\x01\x03\x00\x01\x00\x00\x00\x01\x00")  # the photometric entry becomes the predictor
        head = head[:at] + b"\x3d\x01\x03\x00\x01\x00\x00\x00" + bytes([predictor]) + head[at + 9 :]
        assert (geotiff.decode(head + packed)[0] == a).all()


def test_big_tiff_and_windows(spark, tmp_path):
    a = np.random.default_rng(4).integers(0, 99, (3, 700, 600)).astype("int16")
    g = GridSpec.square("EPSG:4326", -10.0, 45.0, 0.5, 600, 700)
    blob = geotiff.encode(a, g, -1.0, big=True)
    assert blob[2:4] == b"\x2b\0"
    back, grid, nodata = geotiff.decode(blob)
    assert (back == a).all() and (grid, nodata) == (g, -1.0)
    for tiled in (True, False):
        blob = geotiff.encode(a, g, -1.0, tiled=tiled)
        assert (geotiff.decode(blob, (250, 520, 10, 600), 2)[0] == a[1:2, 250:520, 10:600]).all()
        assert geotiff.decode(blob, (650, 900, -5, 3))[0].shape == (3, 50, 3)
    (tmp_path / "a.tif").write_bytes(blob)
    c = geotiff.read_cells(spark, str(tmp_path), window=(699, 700, 598, 600), band=3).orderBy("col").collect()
    assert [(r["band"], r["row"], r["col"], r["value"]) for r in c] == [(3, 699, k, float(a[2, 699, k])) for k in (598, 599)]


def test_layers_are_written_by_tile(spark, tmp_path):
    g = GridSpec.square("ESRI:54009", 0.0, 0.0, 10.0, 600, 520)
    rows = [(1, 0, 0, 1.5), (1, 519, 599, 2.5), (2, 300, 300, -1.0), (2, 300, 301, None)]
    df = spark.createDataFrame(rows, "band int, row int, col int, value double")
    assert geotiff.write_layer(df, g, str(tmp_path / "x.tif"), bands=3)
    back, grid, nodata = geotiff.decode((tmp_path / "x.tif").read_bytes())
    assert back.shape == (3, 520, 600) and grid == g and nodata == -9999.0
    want = np.full((3, 520, 600), -9999.0, "float32")
    want[0, 0, 0], want[0, 519, 599], want[1, 300, 300] = 1.5, 2.5, -1.0
    assert (back == want).all() and [p.name for p in tmp_path.iterdir() if p.suffix == ".part"] == []
    with pytest.raises(Exception, match="outside"):
        geotiff.write_layer(df.withColumn("row", F.lit(520)), g, str(tmp_path / "y.tif"))


def test_crs_of_prj(spark):
    rows = [('PROJCS["World_Mollweide",GEOGCS["x"]]', "ESRI:54009"), ('GEOGCS["GCS_WGS_1984",DATUM["D"]]', "EPSG:4326"), (" ", None), (None, None), ('PROJCS["Lisbon"]', 'PROJCS["Lisbon"]'),
            ('PROJCS["ETRS89 / TM06",GEOGCS["ETRS89",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","3763"]]', "EPSG:3763")]
    df = spark.createDataFrame(rows, "wkt string, crs string")
    assert [r["got"] for r in df.select(shapefile.crs_of_prj(F.col("wkt")).alias("got")).collect()] == [c for _, c in rows]


def test_jobs_by_group(spark):
    from terracell.sources import sinks

    sc = spark.sparkContext
    sc.setJobGroup("export-7", "seventh")
    spark.range(10).count()
    sc.setLocalProperty("spark.jobGroup.id", None)
    found = sinks.poll(spark, "export-7")
    assert found and set(found.values()) == {"SUCCEEDED"} and sinks.jobs(spark, "other") == {} and sinks.poll(spark, "other", 0.1) == {}

