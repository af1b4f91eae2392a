from __future__ import annotations

from types import SimpleNamespace

import pytest

from terracell import store


def test_tables_are_under_the_shared_folder(spark):
    path = store.new_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    store.discard(spark, path)
    fs, p = store._files(spark, path)
    assert not fs.exists(p)


def test_a_cluster_needs_a_shared_folder():
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        store.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_files_from_pieces(spark, tmp_path):
    path = str(tmp_path / "a" / "x.bin")
    store.write_bytes(spark, path, [b"ab"], (bytes([i]) for i in range(3)))
    assert open(path, "rb").read() == b"ab\0\1\2" and store.exists(spark, path)
    assert store.copy(spark, path, str(tmp_path / "y.bin")) and not store.copy(spark, path, str(tmp_path / "y.bin"))
    assert open(tmp_path / "y.bin", "rb").read() == b"ab\0\1\2"
