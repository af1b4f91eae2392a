from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import oracle
import pytest

from terracell.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, n string, h string"


def table(spark, path, rows):
    frame = spark.createDataFrame([(i, v, 1, "x", "cluster", "n", "h") for i, v in rows], SCHEMA).repartition(3)
    frame.write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def vectors(n=120, dims=64, seed=1):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.2), 3) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[n // 3][1]) for i in range(n // 3)]  # copies
    bad = [(900, None), (901, [*rows[0][1][:-1], None]), (902, [*rows[0][1][:-1], math.nan]), (903, [math.inf, *rows[0][1][1:]]), (904, []), (905, rows[0][1][:3])]
    return rows + [rows[2], (None, rows[3][1])] + bad, len(rows) + 2


def as_floats(v):
    return np.array(v, np.float32).astype(np.float64)


@pytest.mark.parametrize("n", [6, 120])
def test_clusters_like_brute_force(spark, tmp_path, n):
    rows, kept = vectors(n)
    got = sorted((tuple(r) for r in centroids.op13_centroids(spark, table(spark, tmp_path, rows)).collect()), key=repr)
    x = [(i, [math.floor(256 * c) for c in as_floats(v)]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    assert len(x) == kept == len(got)
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    m = [list(v) for _, v in order[:40]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(m))

    for _ in range(5):
        at = [nearest(v)[1] for _, v in x]
        for k in set(at):
            mine = [v for (_, v), a in zip(x, at) if a == k]
            m[k] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [nearest(v) for _, v in x]
    inertia = {k: sum(d for d, c in final if c == k) for _, k in final}
    want = [(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, m[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(x, final)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize(("dims", "width"), [(64, 1), (64, 8), (7, 4), (3, 2), (1, 1)])
def test_blocks_are_lossless(dims, width):
    x = np.random.default_rng(dims).integers(-5, 5, (200, dims)).astype(np.int32)
    starts, subvectors, codes = centroids.encode_blocks(x, width)
    assert (centroids.decode_blocks(starts, subvectors, codes, width, dims) == x).all()
    for b, part in enumerate(centroids.dictionaries(starts, subvectors, width, dims)):
        assert len(np.unique(part, axis=0)) == len(part) == len(np.unique(x[:, b * width : (b + 1) * width], axis=0))


def test_widths_change_nothing(spark, tmp_path, monkeypatch):
    rows, _ = vectors()
    many = [(1000 + i, rows[i % 4][1]) for i in range(400)]
    path = table(spark, tmp_path, rows + many)
    seen = []
    for widths in ((1,), (8, 4, 2, 1), (64, 1)):
        monkeypatch.setattr(centroids, "WIDTHS", widths)
        monkeypatch.setattr(centroids, "CHUNK_ROWS", 50)
        seen.append(sorted(map(repr, centroids.op13_centroids(spark, path).collect())))
    assert seen[0] == seen[1] == seen[2]
    assert centroids.block_width(np.repeat(np.arange(6).reshape(2, 3), 50, axis=0)) > 1


def test_no_vectors(spark, tmp_path):
    path = table(spark, tmp_path, [(1, None), (2, [1.0])])
    assert centroids.op13_centroids(spark, path).collect() == [] == whitening.op11_whitening(spark, table(spark, tmp_path / "b", [(1, None), (2, [])])).collect()
    assert whitening.op11_whitening(spark, table(spark, tmp_path / "c", [(1, [1.0, 2.0])] * 3)).collect() == []


def test_too_large_components_raise(spark, tmp_path):
    with pytest.raises(Exception, match="too large"):
        centroids.op13_centroids(spark, table(spark, tmp_path, [(1, [1e30] * 64)])).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.op11_whitening(spark, table(spark, tmp_path / "b", [(1, [1e30, 1.0]), (2, [1.0, 2.0])])).collect()


@pytest.mark.parametrize("sql", ["centroids", "whitening"])
def test_sql(spark, sql):
    if sql == "centroids":
        oracle.check(spark, centroids.op13_centroids, centroids.OP13_SQL)
    else:
        oracle.check(spark, whitening.whitening_deviations, whitening.DEVIATION_SQL)


@pytest.mark.parametrize("wide", [False, True])
def test_whitens_like_brute_force(spark, tmp_path, wide, monkeypatch):
    rows, kept = vectors(dims=20)
    if wide:  # squares are summed as Python integers
        monkeypatch.setattr(whitening, "SMALL", 3)
        rows = [(i, v and [c and 3e5 * c for c in v]) for i, v in rows]
    got = whitening.op11_whitening(spark, table(spark, tmp_path, rows)).toPandas()
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in as_floats(v)]) for i, v in rows if v is not None and len(v) == 20 and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == 16 * len(x) == 16 * kept
    fit = sorted({tuple(v) for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * a - b for a, b in zip(v, s)] for v in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(20)] for i in range(20)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), e / np.trace(v), rtol=1e-9)
    deviation = {tuple(v): sum((n * a - b) ** 2 for a, b in zip(v, s)) for _, v in x}
    for i, v in x[:60]:
        mine = got[got.vec_id == i].drop_duplicates().sort_values("component")
        assert set(mine.deviation) == {deviation[tuple(v)]}
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(v, s)])
        want = centred @ q / np.sqrt(e)
        assert np.allclose(np.abs(mine.whitened.to_numpy()), np.abs(want), atol=1e-7)


def test_rank(spark, tmp_path):
    """Two dimensions of five vary, one with the other."""
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 1.0, -3.0, 0.5]) for i in range(30)]
    got = whitening.op11_whitening(spark, table(spark, tmp_path, rows)).toPandas()
    assert set(got.component) == {1} and len(got) == 30 and set(got.n) == {7} and abs(got.explained.iloc[0] - 1) < 1e-12


def test_deviation_beyond_a_long():
    f = whitening.Fit(1 << 40, (5 << 40, 7 << 40), np.ones(2), np.eye(2), np.ones(2) / 2)
    assert f.deviations(np.array([[5, 7], [6, 7], [1005, 7]])) == [0, None, None]
    small = whitening.Fit(3, (16, 21), np.ones(2), np.eye(2), np.ones(2) / 2)
    assert small.deviations(np.array([[5, 7], [6, 7]])) == [1, 4]
