"""Clustering around centroids over dictionary-encoded dimension blocks.

Vectors of whole numbers are written once as chunks.  A chunk cuts the dimensions into blocks and keeps, for each
block, its distinct subvectors and one code per vector, so nothing is lost.  In a round the distances of the distinct subvectors to
all centroids are computed once, and the distance of a vector is the sum of what its codes stand for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from .vectext import give_back, tidy
from .vectors import scaled, usable

#: Vectors of a chunk at most; the work arrays of a task follow from it.
CHUNK_ROWS = 1 << 14
#: Widths of a block of dimensions, tried from the widest; the dictionaries of a chunk hold this share of its vectors at most, or the width is 1.
WIDTHS, DICTIONARY_SHARE = (8, 4, 2, 1), 0.25
#: Vectors whose distances are summed at once.
SLICE_ROWS = 2048
#: Scaled components up to this size have squared distances that fit a long for 64 dimensions, and sums that do for 2**35 vectors.
LIMIT = float(1 << 27)

_ENCODED = "width int, n int, vec_ids array<long>, starts array<int>, subvectors array<int>, codes binary"


def encode_blocks(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each block's dictionary, distinct subvectors one after another, codes by block and vector) of rows of whole numbers."""
    starts, subvectors, codes = [0], [], []
    for at in range(0, x.shape[1], width):
        part = np.ascontiguousarray(x[:, at : at + width])
        if part.shape[1] == 1:
            distinct, code = np.unique(part[:, 0], return_inverse=True)
        else:
            rows, code = np.unique(part.view(np.dtype((np.void, part.itemsize * part.shape[1]))).ravel(), return_inverse=True)
            distinct = rows.view(x.dtype)
        subvectors.append(distinct.ravel())
        codes.append(code.ravel())
        starts.append(starts[-1] + len(subvectors[-1]) // part.shape[1])
    return np.array(starts, np.int32), np.concatenate(subvectors), np.array(codes, np.int64)


def decode_blocks(starts: np.ndarray, subvectors: np.ndarray, codes: np.ndarray, width: int, dims: int) -> np.ndarray:
    """The rows of :func:`encode_blocks`."""
    out = np.empty((codes.shape[1], dims), subvectors.dtype)
    for b, part in enumerate(dictionaries(starts, subvectors, width, dims)):
        out[:, b * width : b * width + part.shape[1]] = part[codes[b]]
    return out


def dictionaries(starts: np.ndarray, subvectors: np.ndarray, width: int, dims: int) -> Iterator[np.ndarray]:
    """Distinct subvectors of each block; the last block may be narrower."""
    at = 0
    for b in range(len(starts) - 1):
        w, n = min(width, dims - b * width), int(starts[b + 1] - starts[b])
        yield subvectors[at : at + n * w].reshape(n, w)
        at += n * w


def block_width(x: np.ndarray, share: float = DICTIONARY_SHARE) -> int:
    """The widest block whose dictionaries are small beside the rows; the first block that is not tells, so a width that fails costs little."""
    for w in WIDTHS:
        if w == 1 or all(len(np.unique(np.ascontiguousarray(x[:, i : i + w]), axis=0)) <= share * len(x) for i in range(0, x.shape[1], w)):
            return w
    return 1


def write_encoded(vectors: DataFrame, dims: int, path: str) -> None:
    """Writes ``vec_id, x`` (longs of ``dims`` components) as encoded chunks, as they lie: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, x = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            width = block_width(x)
            starts, subvectors, codes = encode_blocks(x, width)
            kind = np.uint16 if np.diff(starts).max(initial=0) <= 1 << 16 else np.uint32
            row = [[width], [len(x)], [ids], [starts], [subvectors], [codes.astype(kind).tobytes()]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["width", "n", "vec_ids", "starts", "subvectors", "codes"])

        for b in batches:
            for i in range(0, b.num_rows, CHUNK_ROWS):
                c = b.slice(i, CHUNK_ROWS)
                x = c.column("x").flatten().to_numpy().reshape(c.num_rows, dims).astype(np.int32)
                if held and sum(len(h[1]) for h in held) + len(x) > CHUNK_ROWS:
                    yield flush()
                held.append((c.column("vec_id"), x))
        if held:
            yield flush()

    vectors.select("vec_id", "x").mapInArrow(tidy(run), _ENCODED).write.parquet(path)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, tuple]]:
    """For each chunk: ids, nearest centroid (the smaller number on ties), squared distance, and its encoding."""
    dims = centroids.shape[1]
    for width, n, ids, starts, subvectors, codes in zip(*(batch.column(k) for k in ("width", "n", "vec_ids", "starts", "subvectors", "codes"))):
        width, n = width.as_py(), n.as_py()
        starts, subvectors = starts.values.to_numpy(), subvectors.values.to_numpy().astype(np.int64)
        blocks = len(starts) - 1
        code = np.frombuffer(codes.as_buffer(), np.uint16 if len(codes.as_buffer()) == 2 * n * blocks else np.uint32).reshape(blocks, n)
        # Exact distances of all distinct subvectors to all centroids, once.
        table = np.empty((int(starts[-1]), len(centroids)), np.int64)
        for b, part in enumerate(dictionaries(starts, subvectors, width, dims)):
            to = centroids[:, b * width : b * width + part.shape[1]]
            into = table[starts[b] : starts[b + 1]]
            into[:] = 0
            for j in range(part.shape[1]):
                d = part[:, j, None] - to[None, :, j]
                into += d * d
        cluster, distance = np.empty(n, np.int64), np.empty(n, np.int64)
        for s in range(0, n, SLICE_ROWS):
            total = table[starts[0] + code[0, s : s + SLICE_ROWS].astype(np.int64)]
            for b in range(1, blocks):
                total += table[starts[b] + code[b, s : s + SLICE_ROWS].astype(np.int64)]
            cluster[s : s + SLICE_ROWS] = total.argmin(axis=1)
            distance[s : s + SLICE_ROWS] = total.min(axis=1)
        yield ids.values, cluster, distance, (starts, subvectors, code, width)


def centroid_sums(encoded: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (vectors nearest to it, their sum)}, at most a row for each centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, cluster, _, (starts, subvectors, code, width) in _assigned(batch, centroids):
                count += np.bincount(cluster, minlength=k)
                # How often each centroid has each subvector, times the subvectors.
                for b, part in enumerate(dictionaries(starts, subvectors, width, dims)):
                    often = np.bincount(cluster * len(part) + code[b], minlength=k * len(part)).reshape(k, len(part))
                    total[:, b * width : b * width + part.shape[1]] += often @ part
                give_back()
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = encoded.mapInArrow(tidy(run), "cluster long, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dims)])
    return {r[0]: (r[1], list(r[2:])) for r in sums.collect()}


def start_centroids(vectors: DataFrame, dims: int, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``; of repeated ids the smaller vector first; null ids come last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(name.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), dims)


def cluster_vectors(rows: DataFrame, dims: int = 64, k: int = 40, rounds: int = 5, scale: float = 256.0, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, cluster, distance`` of every usable vector, the final centroids).

    Components become ``floor(scale * x)``.  Each round assigns every vector to its nearest centroid and moves each centroid to the floor of the mean of
    its vectors; one without vectors stays.  Then vectors are assigned once more.  Vectors with a null, NaN or infinite component, or another number of components
    than ``dims``, are left out; repeated rows and null ids count as rows; fewer vectors than ``k`` give fewer centroids, and an empty table none and no rows.
    Scaled components beyond 2**27 raise, as distances would not fit a long.

    Vectors are read twice and written once, encoded; a round reads the encoded chunks and shuffles one row for each
    centroid and task.  The driver holds the centroids only.
    """
    spark = rows.sparkSession
    vectors = usable(rows, vec_id, vector, dims).select("vec_id", scaled(F.col("vector"), scale, limit=LIMIT).alias("x"))
    centroids = start_centroids(vectors, dims, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    path = store.new_path(spark, "vectors-encoded")
    write_encoded(vectors, dims, path)
    encoded = spark.read.parquet(path)
    for _ in range(rounds):
        for c, (n, total) in centroid_sums(encoded, centroids).items():
            centroids[c] = [t // n for t in total]
    final = store.new_path(spark, "vectors-assigned")
    assign(encoded, centroids).write.parquet(final)
    store.discard(spark, path)
    return spark.read.parquet(final), centroids


def assign(encoded: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of all vectors of encoded chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, cluster, distance, _ in _assigned(batch, centroids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return encoded.mapInArrow(tidy(run), "vec_id long, cluster int, distance long")


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia, inertia, centroid_sha256``; these are at most one row for each centroid and are broadcast."""
    sums = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}
    all_of_them = sum(sums.values())
    text = [",".join(map(str, c)) for c in centroids.tolist()]
    facts = [(c, s, all_of_them, hashlib.sha256(text[c].encode()).hexdigest()) for c, s in sorted(sums.items())]
    table = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 40 centroids, 5 rounds, over all embeddings."""
    return with_inertia(*cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds as a chain of tables."""
    near = """SELECT id, x, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (
      SELECT v.id, v.x, m.c, CAST(list_sum(list_transform(list_zip(v.x, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {m} m
    ) GROUP BY id, x"""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) for e in embedding] AS x FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(m=f'm{r}')})",
            f"""s{r} AS MATERIALIZED (SELECT c, list(CAST(floor_of AS BIGINT) ORDER BY i) AS m FROM (
      SELECT c, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY c, i) GROUP BY c)""",
            f"m{r + 1} AS MATERIALIZED (SELECT m{r}.c, coalesce(s{r}.m, m{r}.m) AS m FROM m{r} LEFT JOIN s{r} ON m{r}.c = s{r}.c)",
        ]
    parts.append(f"z AS MATERIALIZED ({near.format(m=f'm{rounds}')})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(z.c AS INTEGER) AS cluster, z.d AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM z JOIN v ON z.id = v.id JOIN m{rounds} m ON z.c = m.c"""


OP13_SQL = _sql()
