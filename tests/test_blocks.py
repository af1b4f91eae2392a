from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.model import GridSpec
from terracell.sources import blocks as B
from terracell.sources import geotiff as T


def layer(bands=2, height=700, width=530, seed=1):
    a = np.random.default_rng(seed).integers(0, 100, (bands, height, width)).astype(np.float32)
    a[0, 3, 4] = np.nan
    a[-1, 5, 6] = -9999.0
    return a


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tiffs")
    (at / "sub").mkdir()
    grid = GridSpec.square("EPSG:3763", 0.0, 700.0, 1.0, 530, 700)
    (at / "tiled.tif").write_bytes(T.encode(layer(), grid, -9999.0))
    (at / "sub" / "strips.tiff").write_bytes(T.encode(layer(1, seed=2), grid, -9999.0, compress=False, tiled=False, big=True))
    (at / "notes.txt").write_text("no raster")
    return str(at)


def reader(path, **options):
    return B.BlockReader({"path": path, "partitioncells": "100000", **options})


def test_partitions_are_blocks_of_a_window(folder):
    every = reader(folder).partitions()
    assert sum((p.rows[1] - p.rows[0]) * (p.cols[1] - p.cols[0]) for p in every) == 3 * 700 * 530
    tiled = [p for p in every if p.path.endswith("tiled.tif")]
    assert len(tiled) > 8 and all(p.rows[0] % 256 == 0 and p.cols[0] % 256 == 0 for p in tiled)
    few = reader(folder, window="300,310,0,21", band="2").partitions()
    assert [(p.band, p.rows, p.cols) for p in few] == [(2, (300, 310), (0, 21))]
    assert reader(folder, band="7").partitions() == [] == reader(folder, window="900,950,0,9").partitions()


def test_only_wanted_bytes_are_read(folder, monkeypatch):
    read = []
    monkeypatch.setattr(B, "FRONT", 1 << 12)
    plain = B.Ranges.__getitem__
    monkeypatch.setattr(B.Ranges, "__getitem__", lambda self, part: read.append(part.stop - part.start if part.start else part.stop) or plain(self, part))
    r = reader(folder, window="0,10,0,10", band="1")
    (p,) = [p for p in r.partitions() if p.path.endswith("tiled.tif")]
    read.clear()
    got = sum(b.num_rows for b in r.read(p))
    assert got == 100 and sum(read) < 256 * 256 * 4 + 4096  # one block of nine, and the tags


def test_cells_are_those_of_the_files(spark, folder):
    df = B.read_blocks(spark, folder, partition_cells=100_000)
    a, b = layer(), layer(1, seed=2)
    assert df.count() == a.size + b.size
    name = F.regexp_extract("path", r"[^/]*$", 0)
    got = {(r["n"], r["band"]): (r["s"], r["k"]) for r in df.groupBy(name.alias("n"), "band").agg(F.sum("value").alias("s"), F.count("value").alias("k")).collect()}
    clean = lambda x: x[~np.isnan(x) & (x != -9999.0)].astype(float)
    assert got == {("tiled.tif", 1): (clean(a[0]).sum(), a[0].size - 1), ("tiled.tif", 2): (clean(a[1]).sum(), a[1].size - 1), ("strips.tiff", 1): (clean(b[0]).sum(), b[0].size - 2)}
    part = B.read_blocks(spark, folder, window=(250, 262, 501, 9999), band=1).where(name == "tiled.tif")
    assert {(r["row"], r["col"]): r["value"] for r in part.collect()} == {(r, c): float(a[0, r, c]) for r in range(250, 262) for c in range(501, 530)}
    one = B.read_blocks(spark, f"file:{folder}/tiled.tif")
    assert one.where("row = 3 and col = 4").orderBy("band").collect()[0]["value"] is None
    same = T.read_cells(spark, folder).groupBy("band").agg(F.sum("value")).orderBy("band").collect()
    assert df.groupBy("band").agg(F.sum("value")).orderBy("band").collect() == same


def test_interleaved_samples(spark, tmp_path):
    """Three samples in each block: partitions have all bands, and a band filter still reads right."""
    import struct

    h, w, n = 5, 7, 3
    a = np.arange(h * w * n, dtype="<u2").reshape(h, w, n)
    tags = [(256, 3, w), (257, 3, h), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 200), (277, 3, n), (278, 3, h), (279, 4, a.nbytes), (284, 3, 1), (339, 3, 1)]
    head = struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in tags) + b"\0" * 4
    (tmp_path / "rgb.tif").write_bytes(head.ljust(200, b"\0") + a.tobytes())
    df = B.read_blocks(spark, str(tmp_path))
    assert {(r["band"], r["row"], r["col"]): r["value"] for r in df.collect()} == {(k + 1, i, j): float(a[i, j, k]) for k in range(n) for i in range(h) for j in range(w)}
    two = B.read_blocks(spark, str(tmp_path), window=(1, 2, 0, 7), band=2)
    assert {(r["band"], r["col"]): r["value"] for r in two.collect()} == {(2, j): float(a[1, j, 1]) for j in range(w)}
