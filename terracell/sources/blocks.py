"""GeoTIFF files block by block: a Python data source whose partitions are windows of whole blocks, read by their offsets.

``spark.read.format("geotiff").load(path)`` gives ``path, band, row, col, value``.  No task holds a file, so files of any size are read by as many
tasks as their blocks allow.  A window and a band are options, and choose blocks before partitions are made.  They are not taken from filters: Spark 4.1 keeps the
filters that were pushed into a Python source with its DataFrame, and a later query over the same DataFrame would get them too.

Files are opened by pyarrow, so a path is in a local or shared folder or in a store that pyarrow knows; for others there is
:func:`terracell.sources.geotiff.read_cells`, which goes through Spark's readers and holds whole files.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import geotiff as T

#: Cells that a partition has at most, unless one block has more.
PARTITION_CELLS = 1 << 22
#: Bytes read at once from the front of a file, which often hold all tags.
FRONT = 1 << 16
#: Rows given to Spark at once.
BATCH_CELLS = 1 << 16


class Ranges:
    """A file as :func:`terracell.sources.geotiff.decode` takes it: slices are read when they are asked for."""

    def __init__(self, path: str):
        store, where = _store(path)
        self.file = store.open_input_file(where)
        self.size = self.file.size()
        self.front = self.file.read_at(min(FRONT, self.size), 0)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        if b <= len(self.front):
            return self.front[a:b]
        return self.file.read_at(max(0, b - a), a)

    def __enter__(self) -> "Ranges":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^file:/", path):
        path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _listed(path: str, pattern: str) -> list[str]:
    """Files under a folder whose names match, sorted, or the file itself; hidden ones, such as checksums, are left out."""
    store, where = _store(path)
    if store.get_file_info(where).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(where, recursive=True))
    head = path.rstrip("/")
    return sorted(head + f.path[len(where.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatch(f.base_name, pattern))


class Part(InputPartition):
    """A window of one file; without a band all of them."""

    def __init__(self, path: str, band: int | None, rows: tuple[int, int], cols: tuple[int, int]):
        self.path, self.band, self.rows, self.cols = path, band, rows, cols


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif*")
        self.most = int(options.get("partitioncells", PARTITION_CELLS))
        self.window = tuple(int(v) for v in options["window"].split(",")) if options.get("window") else None
        self.band = int(options["band"]) if options.get("band") else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _listed(self.path, self.pattern):
            with Ranges(path) as file:
                shape = T.layout(file)
            # Blocks of interleaved samples hold all bands.
            bands = [self.band] if self.band else list(range(1, shape.bands + 1)) if shape.separate else [None]
            if self.band and not 1 <= self.band <= shape.bands:
                continue
            r0, r1, c0, c1 = self.window or (0, shape.height, 0, shape.width)
            rows, cols = (max(0, r0), min(shape.height, r1)), (max(0, c0), min(shape.width, c1))
            per = 1 if shape.separate else shape.bands
            wide = max(1, min(-(-(cols[1] - cols[0]) // shape.block_width), self.most // (shape.block_width * shape.block_height * per))) * shape.block_width
            high = max(1, self.most // (wide * shape.block_height * per)) * shape.block_height
            for band in bands:
                for r in _cut(rows, high):
                    out += [Part(path, band, r, c) for c in _cut(cols, wide)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with Ranges(partition.path) as file:
            bands, _, nodata = T.decode(file, (*partition.rows, *partition.cols), partition.band)
        step = max(1, BATCH_CELLS // max(1, bands.shape[2]))
        for i, plane in enumerate(bands):
            band = partition.band or i + 1
            for r in range(0, len(plane), step):
                v = plane[r : r + step].astype(np.float64)
                missing = np.isnan(v) if nodata is None else np.isnan(v) | (v == nodata)
                row, col = np.indices(v.shape, np.int32)
                n = v.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * n), pa.array(np.full(n, band, np.int32)), pa.array(row.ravel() + np.int32(r + partition.rows[0])), pa.array(col.ravel() + np.int32(partition.cols[0])), pa.array(v.ravel(), mask=missing.ravel())],
                    ["path", "band", "row", "col", "value"])


def _cut(span: tuple[int, int], step: int) -> list[tuple[int, int]]:
    """Parts of a span that end at multiples of ``step``."""
    a, b = span
    return [(max(a, s), min(b, s + step)) for s in range(a // step * step, b, step)] if a < b else []


class GeoTiffSource(DataSource):
    """Options: ``pattern`` of file names under a folder (``*.tif*``), ``window`` (first row, row after the last, first column, column after the last), ``band``, ``partitionCells``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "path string, band int, row int, col int, value double"

    def reader(self, schema) -> BlockReader:
        return BlockReader({k.lower(): v for k, v in self.options.items()})


def read_blocks(spark: SparkSession, path: str, pattern: str = "*.tif*", window: T.Window | None = None, band: int | None = None, partition_cells: int = PARTITION_CELLS) -> DataFrame:
    """Cells of all files under ``path``, of a ``window`` and a ``band`` if given; NoData and NaN are NULL.

    Rows and columns count from the corner of a file; a file without the band, or outside the window, has no cells.
    """
    spark.dataSource.register(GeoTiffSource)
    options = {"pattern": pattern, "partitionCells": str(partition_cells)} | ({"window": ",".join(map(str, window))} if window else {}) | ({"band": str(band)} if band else {})
    return spark.read.format("geotiff").options(**options).load(path)
