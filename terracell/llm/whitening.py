"""Whitening of embeddings with covariances by polarisation.

Components are whole numbers, so variances are exact: the covariance of two dimensions is half of what the variance of
their sum has beyond the variances of both.  Spark adds up one squared centred value for each dimension and each sum of two dimensions;
the matrix is put together from differences of these totals and decomposed on the driver, where it has as many entries as pairs of dimensions.

A centred value ``n*x - S`` (n vectors with sum S) is kept in two parts, ``n*u - r`` with ``u = x - floor(S/n)`` and ``0 <= r < n``.
Its square is ``n²u² - 2nru + r²``; over all vectors the sum of u is r, so the exact total of squares follows from the total of
u², which is small, in whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from .vectext import give_back, tidy
from .vectors import scaled, usable

#: Vectors whose squares are summed at once.
SLICE_ROWS = 4096
#: Up to this size of u the squares of sums of a slice fit a long; beyond it they are summed as Python integers.
SMALL = 1 << 24
#: Components with less than this share of the largest eigenvalue, times the number of dimensions, are rounding.
RANK_EPS = 2.0**-50


@dataclass(frozen=True)
class Fit:
    """n vectors of the fit list, their sum by dimension, and the components by falling eigenvalue."""

    n: int
    total: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.total], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.total]

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        """Centred rows on the first ``k`` components, over the roots of their eigenvalues."""
        centred = (x - self.base).astype(np.float64) - np.array([float(Fraction(r, self.n)) for r in self.rest])
        return centred @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n*x - S)**2``, exact; None where it does not fit a long."""
        u, rest = x - self.base, self.rest
        top = int(np.abs(u).max(initial=0)) + 1
        if (self.n * top) ** 2 * x.shape[1] < 1 << 62:
            y = u * self.n - np.array(rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = u.astype(object) * self.n - np.array(rest, object)
        return [d if d < 1 << 63 else None for d in (y * y).sum(axis=1)] if x.shape[1] else [0] * len(x)


def whole_vectors(rows: DataFrame, scale: float, shift: int, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, x`` of usable vectors that have as many components as most of them have, the larger number on a tie."""
    good = usable(rows, vec_id, vector)
    sizes = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = sizes[0]["d"] if sizes else 0
    return good.where(F.size("vector") == dims).select("vec_id", scaled(F.col("vector"), scale, shift).alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dims)


def square_totals(fit_list: DataFrame, base: np.ndarray) -> dict[tuple[int, int], int]:
    """{(i, j): total of (u_i + u_j)² over the fit list, or of u_i² where i = j}: a row for each pair of dimensions and task is shuffled."""
    dims = len(base)
    first, second = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(first), object)
        some = False
        for b in batches:
            for s in range(0, b.num_rows, SLICE_ROWS):
                c = b.slice(s, SLICE_ROWS)
                # Dimensions by row, so that sums of two dimensions are sums of rows.
                u = np.ascontiguousarray((_matrix(c, dims) - base).T)
                if int(np.abs(u).max(initial=0)) > SMALL:
                    u = u.astype(object)
                parts = []
                for i in range(dims):
                    pair = u[i] + u[i:]
                    pair[0] = u[i]
                    parts.append((pair * pair).sum(axis=1))
                total += np.concatenate(parts).astype(object)
                some = True
            give_back()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array([str(t) for t in total])], ["i", "j", "t"])

    parts = fit_list.mapInArrow(tidy(run), "i int, j int, t string").groupBy("i", "j").agg(F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
    return {(r[0], r[1]): int(r[2]) for r in parts.collect()}


def covariances(n: int, total: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix with divisor n, each entry rounded once from the exact fraction."""
    d = len(total)
    r = [s % n for s in total]
    # Totals of squares of n*x - S, of single dimensions and of sums of two.
    single = [n * n * squares[i, i] - n * r[i] * r[i] for i in range(d)]
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = float(Fraction(single[i], n**3))
        for j in range(i + 1, d):
            both = n * n * squares[i, j] - n * (r[i] + r[j]) ** 2
            v[i, j] = v[j, i] = float(Fraction(both - single[i] - single[j], 2 * n**3))
    return v


def fit(fit_list: DataFrame) -> Fit | None:
    """Components of distinct vectors ``x`` of one number of dimensions; None without vectors, without dimensions or without any variance.

    Two passes: number and sums, then squares.  The driver holds one number for each pair of dimensions.  A component's sign is the one that makes
    its entry of largest size positive.
    """
    width = fit_list.select(F.size("x").alias("d")).limit(1).collect()
    if not width or not width[0][0]:
        return None
    dims = width[0][0]
    head = fit_list.agg(F.count("*"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(dims)]).first()
    n, total = head[0], [int(t) for t in head[1:]]
    v = covariances(n, total, square_totals(fit_list, np.array([s // n for s in total], np.int64)))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int(np.count_nonzero(values > max(values[0], 0.0) * dims * RANK_EPS))
    if not kept:
        return None
    vectors = vectors[:, :kept] * np.sign(vectors[np.abs(vectors[:, :kept]).argmax(axis=0), np.arange(kept)])
    return Fit(n, tuple(total), values[:kept], vectors, values[:kept] / np.trace(v))


def identity_error(fit_list: DataFrame, f: Fit, k: int) -> float:
    """Largest difference between the covariance of the whitened fit list and the identity, from all whitened values."""
    k = min(k, len(f.values))
    dims = len(f.total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, mean = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            for s in range(0, b.num_rows, SLICE_ROWS):
                z = f.whiten(_matrix(b.slice(s, SLICE_ROWS), dims), k)
                outer += z.T @ z
                mean += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), pa.array([*outer, mean], pa.list_(pa.float64()))], ["i", "row"])

    # Components are centred before they are projected, so what the means add is rounding.
    rows = fit_list.mapInArrow(tidy(run), "i long, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(k)]).collect()
    table = np.array([list(r[1:]) for r in sorted(rows)]) / f.n
    return float(np.abs(table[:k] - np.outer(table[k], table[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, k: int = 16, scale: float = 64.0, shift: int = 1_000_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector and its first ``k`` components.

    Components of a vector become ``floor(scale * c) + shift``; the fit list has each distinct vector once, so copies of a vector do not
    count twice, and it is shuffled after each task has dropped its own copies.  Vectors with a null, NaN or infinite component are left out, and so are those
    with another number of components than most.  Repeated rows and null ids come back as they are; components without variance are not
    numbered, so a table whose vectors are all alike, or empty, gives no rows.  A deviation that does not fit a long is null; scaled components beyond 2**53 raise.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = whole_vectors(rows, scale, shift, vec_id, vector)
    path = store.new_path(spark, "fit-list")
    x.select("x").distinct().write.parquet(path)
    fit_list = spark.read.schema("x array<long>").parquet(path)
    f = fit(fit_list)
    if f is None:
        return spark.createDataFrame([], schema)
    k = min(k, len(f.values))
    error, dims = identity_error(fit_list, f, k), len(f.total)
    store.discard(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, SLICE_ROWS):
                c = b.slice(s, SLICE_ROWS)
                m = _matrix(c, dims)
                each = np.repeat(np.arange(len(m)), k)
                columns = [c.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(each), f.n)),
                           pa.array(f.deviations(m), pa.int64()).take(pa.array(each)), pa.array(f.whiten(m, k).ravel()), pa.array(np.tile(f.explained[:k], len(m))), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(tidy(run), schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the first 16 components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact columns of op11, the part that SQL can express."""
    return op11_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


DEVIATION_SQL = """
WITH v AS (SELECT row_number() OVER () AS id, vec_id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) + 1000000 for e in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
f AS (SELECT DISTINCT x FROM v), n AS (SELECT count(*) AS n FROM f),
s AS (SELECT i, sum(x[i]) AS s FROM f, range(1, 65) AS t(i) GROUP BY i)
SELECT v.vec_id, any_value(n.n) AS n, CAST(sum((n.n * x[i] - s.s) * (n.n * x[i] - s.s)) AS BIGINT) AS deviation FROM v, n, s GROUP BY v.id, v.vec_id
"""
