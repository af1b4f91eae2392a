"""GeoTIFF files, classic and big: strips or tiles, uncompressed, deflate or LZW, integer and floating samples.

Files are written tile by tile: tasks compress 256 x 256 blocks, and the compressed blocks are streamed into the
file, so no layer is ever one array.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..model import GridSpec

#: Tag numbers (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_ASCII, NODATA = 33550, 33922, 34264, 34735, 34737, 42113
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Compression numbers: none, LZW, deflate (fixed values).
_NONE, _LZW, _DEFLATE = 1, 5, (8, 32946)
BLOCK = 256
#: Bytes from which a file is a big one, with room for the header.
BIG = (1 << 32) - (1 << 20)
#: Geographic type and projected type keys, and the citation key (fixed values).
_GEOGRAPHIC, _PROJECTED, _CITATION = 2048, 3072, 1026


Window = tuple[int, int, int, int]


def decode(blob: bytes, window: Window | None = None, band: int | None = None) -> tuple[np.ndarray, GridSpec, float | None]:
    """(bands, rows, cols) array, grid and NoData of the first image of a file.

    ``window``: first row, row after the last, first column, column after the last; only its blocks are unpacked.  ``band``
    counts from 1.  The grid is that of the whole file.
    """
    order, tags = _header(blob)
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    samples, bits = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (8,))
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{bits[0] // 8}")
    planar = tags.get(PLANAR, (1,))[0] == 2
    packed, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if packed not in (_NONE, _LZW, *_DEFLATE) or predictor not in (1, 2, 3):
        raise ValueError(f"compression {packed} with predictor {predictor} is not supported")
    if TILE_OFFSETS in tags:
        bw, bh, offs, counts = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        bw, bh, offs, counts = w, min(h, tags.get(ROWS_PER_STRIP, (h,))[0]), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    r0, r1, c0, c1 = window or (0, h, 0, w)
    r0, r1, c0, c1 = max(0, r0), min(h, r1), max(0, c0), min(w, c1)
    across, down = -(-w // bw), -(-h // bh)
    per = 1 if planar else samples
    first_r, first_c = r0 // bh, c0 // bw
    rows, cols = max(0, -(-r1 // bh) - first_r), max(0, -(-c1 // bw) - first_c)
    bands = range(samples) if band is None else range(band - 1, band)
    nodata = _nodata(tags)
    out = np.full((len(bands), rows * bh, cols * bw), 0 if nodata is None or (kind != "f" and nodata != nodata) else nodata, dtype)
    for plane in bands if planar else (0,):
        for r in range(first_r, first_r + rows):
            for c in range(first_c, first_c + cols):
                i = plane * across * down + r * across + c
                if not counts[i]:  # a block that was never written
                    continue
                raw = blob[offs[i] : offs[i] + counts[i]]
                raw = zlib.decompress(raw) if packed in _DEFLATE else _unpack_lzw(raw) if packed == _LZW else raw
                a = _samples(raw, dtype, bw, per, predictor)
                at = slice((r - first_r) * bh, (r - first_r) * bh + len(a)), slice((c - first_c) * bw, (c - first_c + 1) * bw)
                for k, s in enumerate(bands):
                    if planar and s == plane or not planar:
                        out[(k, *at)] = a[:, :, 0 if planar else s]
    part = out[:, r0 - first_r * bh : r1 - first_r * bh, c0 - first_c * bw : c1 - first_c * bw]
    return part, GridSpec(_crs(tags), _transform(tags), w, h), nodata


@dataclass(frozen=True)
class Layout:
    """Sizes of a file and of its blocks; ``separate``: each block has one band."""

    width: int
    height: int
    bands: int
    block_width: int
    block_height: int
    separate: bool


def layout(blob: bytes) -> Layout:
    """From the tags alone."""
    _, tags = _header(blob)
    w, h, n = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    block = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if TILE_OFFSETS in tags else (w, min(h, tags.get(ROWS_PER_STRIP, (h,))[0]))
    return Layout(w, h, n, *block, n == 1 or tags.get(PLANAR, (1,))[0] == 2)


def _samples(raw: bytes, dtype: np.dtype, width: int, per: int, predictor: int) -> np.ndarray:
    """(rows, width, samples) of an unpacked block."""
    size = width * per * dtype.itemsize
    rows = len(raw) // size
    if predictor == 3:
        # Bytes of one significance together, the highest first, each row as differences.
        x = np.frombuffer(raw, np.uint8, rows * size).reshape(rows, -1, per).cumsum(axis=1, dtype=np.uint8)
        x = x.reshape(rows, dtype.itemsize, width * per).transpose(0, 2, 1)
        return np.ascontiguousarray(x).view(dtype.newbyteorder(">")).reshape(rows, width, per)
    a = np.frombuffer(raw, dtype, rows * width * per).reshape(rows, width, per)
    return np.cumsum(a, axis=1, dtype=dtype) if predictor == 2 else a


def _unpack_lzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the highest bit first; 256 starts anew and 257 ends."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, held, bits, last = list(start), bytearray(), 9, 0, 0, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
            width = min(12, (len(table) + 1).bit_length())
        out += entry
        last = entry
    return bytes(out)


def _header(blob: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags) of a classic or big file; ``blob`` is only sliced, so it may read slices when they are asked for."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(blob[:2]))
    at_place = lambda kind, at: struct.unpack(kind, blob[at : at + struct.calcsize(kind)])
    kind = at_place(order + "H", 2)[0] if order and len(blob) >= 16 else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    word, number, inline = ("Q", "Q", 8) if kind == 43 else ("I", "H", 4)
    at = at_place(order + word, 8 if kind == 43 else 4)[0]
    out, step = {}, 4 + 2 * inline
    first = at + struct.calcsize("<" + number)
    for i in range(at_place(order + number, at)[0]):
        tag, t, n = at_place(order + "HH" + word, first + step * i)
        if t not in _TYPES:
            continue
        where = first + step * i + 4 + inline
        if struct.calcsize("<" + _TYPES[t]) * n > inline:
            where = at_place(order + word, where)[0]
        out[tag] = (blob[where : where + n],) if t == 2 else at_place(order + _TYPES[t] * n, where)
    return order, out


def _transform(tags: dict) -> tuple:
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        return m[0], m[1], m[3], m[4], m[5], m[7]
    sx, sy = tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
    i, j, _, x, y, _ = tags.get(TIEPOINT, (0.0,) * 6)[:6]
    return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy


def _crs(tags: dict) -> str:
    keys, text = tags.get(GEO_KEYS, ()), tags.get(GEO_ASCII, (b"",))[0].decode("latin-1")
    held = {keys[i]: keys[i + 1 : i + 4] for i in range(4, len(keys), 4)}
    for key in (_PROJECTED, _GEOGRAPHIC):
        if key in held and held[key][0] == 0 and held[key][2] < 32767:
            return f"EPSG:{held[key][2]}"
    if _CITATION in held:
        _, n, at = held[_CITATION]
        return text[at : at + n].rstrip("|\0")
    return "LOCAL"


def _nodata(tags: dict) -> float | None:
    if NODATA not in tags:
        return None
    try:
        return float(tags[NODATA][0].rstrip(b"\0 ").decode())
    except ValueError:
        return None


def encode(bands: np.ndarray, grid: GridSpec, nodata: float | None = None, compress: bool = True, tiled: bool = True, big: bool = False) -> bytes:
    """A little-endian GeoTIFF with separate bands in 256 x 256 deflate tiles by default."""
    n, h, w = bands.shape
    bands = bands.astype(bands.dtype.newbyteorder("<"))
    bw, bh = (BLOCK, BLOCK) if tiled else (w, min(h, 64))
    blocks = []
    for band in bands:
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                part = band[r : r + bh, c : c + bw]
                if tiled and part.shape != (bh, bw):
                    part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1])), mode="edge")
                raw = np.ascontiguousarray(part).tobytes()
                blocks.append(zlib.compress(raw) if compress else raw)
    sizes = [len(x) for x in blocks]
    places = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int).tolist()
    return _head(grid, n, bands.dtype, nodata, sizes, places, compress, (bw, bh) if tiled else bh, big) + b"".join(blocks)


def _head(grid: GridSpec, n: int, dtype: np.dtype, nodata: float | None, sizes: list[int], places: list[int], compress: bool, block: tuple[int, int] | int, big: bool) -> bytes:
    """Everything before the blocks, whose ``places`` count from there; ``block``: width and height of a tile, or rows of a strip."""
    a, b, c, d, e, f = grid.transform
    epsg = int(grid.crs[5:]) if grid.crs.upper().startswith("EPSG:") else None
    name = (grid.crs + "|").encode("latin-1", "replace")
    geographic, tiled, word = epsg == 4326, isinstance(block, tuple), "Q" if big else "I"
    keys = [(1024, 0, 1, 2 if geographic else 1), (1025, 0, 1, 1)]
    keys += [(_GEOGRAPHIC if geographic else _PROJECTED, 0, 1, epsg)] if epsg else [(_CITATION, GEO_ASCII, len(name), 0)]
    where = TILE_OFFSETS if tiled else STRIP_OFFSETS
    entries: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (grid.width,)), (HEIGHT, 4, (grid.height,)), (BITS, 3, (dtype.itemsize * 8,) * n), (COMPRESSION, 3, (8 if compress else 1,)), (PHOTOMETRIC, 3, (1,)),
        (SAMPLES, 3, (n,)), (PLANAR, 3, (2,)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[dtype.kind],) * n),
        (TRANSFORM, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
        (GEO_KEYS, 3, (1, 1, 0, len(keys), *[v for k in sorted(keys) for v in k])), (GEO_ASCII, 2, (name,)),
        (TILE_COUNTS if tiled else STRIP_COUNTS, 4, tuple(sizes)), (where, 16 if big else 4, tuple(places)),
    ]
    entries += [(TILE_WIDTH, 4, (block[0],)), (TILE_HEIGHT, 4, (block[1],))] if tiled else [(ROWS_PER_STRIP, 4, (block,))]
    if nodata is not None:
        entries.append((NODATA, 2, (f"{nodata:.17g}\0".encode(),)))
    entries.sort()
    pack = lambda t, v: v[0] if t == 2 else struct.pack("<" + _TYPES[t] * len(v), *v)
    inline, start = (8, 16) if big else (4, 8)
    body = start + (8 if big else 2) + (4 + 2 * inline) * len(entries) + inline
    first = body + sum(len(r) + len(r) % 2 for _, t, v in entries if len(r := pack(t, v)) > inline)
    if not big and first + max((p + k for p, k in zip(places, sizes)), default=0) >= 1 << 32:
        raise ValueError("too large for a classic TIFF file")
    head = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, start, len(entries)) if big else struct.pack("<2sHIH", b"II", 42, start, len(entries))
    extra = b""
    for tag, t, v in entries:
        raw = pack(t, tuple(first + x for x in v) if tag == where else v)
        head += struct.pack("<HH" + word, tag, t, len(raw) if t == 2 else len(v))
        if len(raw) > inline:
            head += struct.pack("<" + word, body + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            head += raw.ljust(inline, b"\0")
    return head + b"\0" * inline + extra


_CELLS = "path string, band int, row int, col int, value double"
_GRIDS = "path string, crs string, transform array<double>, width int, height int, bands int, nodata double, dtype string"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_cells(spark: SparkSession, path: str, pattern: str = "*.tif*", window: Window | None = None, band: int | None = None) -> DataFrame:
    """``path, band, row, col, value`` of all files under ``path``; NoData and NaN are NULL.

    A task decodes a file, of a ``window`` (see :func:`decode`) only its blocks and of a ``band`` only its blocks.  Rows and
    columns count from the corner of the file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, blob in zip(frame["path"], frame["content"]):
                bands, g, nodata = decode(bytes(blob), window, band)
                r0, c0 = (max(0, window[0]), max(0, window[2])) if window else (0, 0)
                for i, plane in enumerate(bands):
                    for r in range(0, len(plane), 64):
                        v = plane[r : r + 64].astype(np.float64)
                        if nodata is not None:
                            v[v == nodata] = np.nan
                        rr, cc = np.indices(v.shape)
                        yield pd.DataFrame({"path": name, "band": np.int32(band or i + 1), "row": (rr.ravel() + r + r0).astype(np.int32), "col": (cc.ravel() + c0).astype(np.int32), "value": v.ravel()})

    return _files(spark, path, pattern).mapInPandas(run, _CELLS).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_grids(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """One catalog row per file, from its tags; no block is unpacked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, blob in zip(frame["path"], frame["content"]):
                bands, g, nodata = decode(bytes(blob), (0, 0, 0, 0))
                rows.append((name, g.crs, list(g.transform), g.width, g.height, len(bands), nodata, bands.dtype.name))
            yield pd.DataFrame(rows, columns=["path", "crs", "transform", "width", "height", "bands", "nodata", "dtype"])

    return _files(spark, path, pattern).mapInPandas(run, _GRIDS)


def packed_tiles(cells: DataFrame, dtype: str = "float32", nodata: float = -9999.0) -> DataFrame:
    """``band, tile_row, tile_col, size, data``: deflate blocks of 256 x 256 from cells ``band, row, col, value``; a task holds one block at a time."""
    at = cells.where("value is not null").select("band", (F.col("row") / BLOCK).cast("int").alias("tile_row"), (F.col("col") / BLOCK).cast("int").alias("tile_col"), "row", "col", "value")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        a = np.full((BLOCK, BLOCK), nodata, np.dtype(dtype).newbyteorder("<"))
        a[part["row"] % BLOCK, part["col"] % BLOCK] = part["value"]
        data = zlib.compress(a.tobytes())
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in ("band", "tile_row", "tile_col")}, "size": [len(data)], "data": [data]})

    return at.groupBy("band", "tile_row", "tile_col").applyInPandas(pack, "band int, tile_row int, tile_col int, size int, data binary")


def write_layer(cells: DataFrame, grid: GridSpec, path: str, dtype: str = "float32", nodata: float = -9999.0, overwrite: bool = False, bands: int | None = None) -> bool:
    """One file, in any store, from cells ``band, row, col, value``; False if it exists and ``overwrite`` is off.

    Tasks pack the blocks into a written table.  The driver learns their sizes, writes the header (a big file from 4 GB on) and
    streams one packed block after another; blocks without cells share one block of NoData.  Cells outside the grid raise.
    """
    spark = cells.sparkSession
    if not overwrite and store.exists(spark, path):
        return False
    at = store.new_path(spark, "tiles")
    inside = (F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width)
    checked = cells.withColumn("row", F.when(inside, F.col("row")).otherwise(F.raise_error(F.lit("a cell outside the grid")).cast("int")))
    packed_tiles(checked, dtype, nodata).write.parquet(at)
    tiles = spark.read.parquet(at)
    down, across = -(-grid.height // BLOCK), -(-grid.width // BLOCK)
    sizes = {(r["band"], r["tile_row"], r["tile_col"]): r["size"] for r in tiles.select("band", "tile_row", "tile_col", "size").toLocalIterator()}
    n = bands or max((b for b, _, _ in sizes), default=1)
    blank = zlib.compress(np.full((BLOCK, BLOCK), nodata, np.dtype(dtype).newbyteorder("<")).tobytes())
    lengths, places, end = [], [], len(blank)
    for key in ((b, r, c) for b in range(1, n + 1) for r in range(down) for c in range(across)):
        lengths.append(sizes.get(key, len(blank)))
        places.append(end if key in sizes else 0)
        end += sizes.get(key, 0)
    head = _head(grid, n, np.dtype(dtype), nodata, lengths, places, True, (BLOCK, BLOCK), end >= BIG)
    ordered = (bytes(r["data"]) for r in tiles.orderBy("band", "tile_row", "tile_col").select("data").toLocalIterator())
    store.write_bytes(spark, path, [head, blank], ordered)
    store.discard(spark, at)
    return True


def write_tiles(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cells as Parquet, clustered by 256 x 256 block and partitioned by layer."""
    block = cells.withColumns({"tile_row": (F.col("row") / BLOCK).cast("int"), "tile_col": (F.col("col") / BLOCK).cast("int")})
    block.repartition("layer", "tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").write.mode(mode).partitionBy("layer").parquet(path)
