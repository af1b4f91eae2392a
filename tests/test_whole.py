"""Queries on tables larger than the smallest ones: nothing is left out."""

from __future__ import annotations

from terracell.queries import geometry, grids


def test_mask_reaches_every_feature(spark, tmp_path):
    keys = range(300)
    spark.createDataFrame([(k, k % 25) for k in keys], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = set()
    for k in keys:
        x, y, w = k % 10 * 20, k // 10 * 20, k % 7 + 1
        for r in range(int(y / 2.5), int((y + 2 * w) / 2.5) + 1):
            for c in range(int(x / 2.5), int((x + w) / 2.5) + 1):
                cx, cy = c * 2.5 + 1.25, r * 2.5 + 1.25
                hole = x + w / 4 <= cx < x + w * 3 / 4 and y + w / 2 <= cy < y + w * 3 / 2
                if x <= cx < x + w and y <= cy < y + 2 * w and not hole:
                    want.add((r, c))
    assert max(r for r, _ in want) > 100
    assert sorted(map(tuple, geometry.mask_cells(spark, str(tmp_path)).select("row", "col").collect())) == sorted(want)


def test_warp_covers_the_raster(spark, tmp_path):
    n = 5000
    spark.createDataFrame([(k, float(k)) for k in range(n)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {int(v) for (v,) in grids.warp_covering(spark, str(tmp_path)).select("value").collect()}
    assert {k // 50 for k in got} == set(range(n // 50)) and {k % 50 for k in got} == set(range(50))
    assert len(got) > n / 2


def test_warp_window_reads_all_parts(spark, tmp_path):
    spark.createDataFrame([(k, float(k)) for k in range(2500)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    plan = grids.warp_nearest(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "< 2000)" not in plan
