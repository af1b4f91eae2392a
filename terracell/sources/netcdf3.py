"""Classic NetCDF files (versions 1 and 2), with calendar decoding of ``time``."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type numbers and list tags (fixed values).
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMS, _VARS, _ATTS = 10, 11, 12
#: Names of the spatial and time dimensions, in any case (fixed values).
LAT, LON, TIME = ("lat", "latitude", "y"), ("lon", "longitude", "x"), ("time", "t")


@dataclass
class Variable:
    dims: tuple[str, ...]
    data: np.ndarray
    attrs: dict = field(default_factory=dict)


def decode(blob: bytes) -> dict[str, Variable]:
    """All variables of a file, scale, offset and fill values not applied."""
    if blob[:3] != b"CDF" or blob[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    wide, at = blob[3] == 2, 4

    def number(kind: str = ">I") -> int:
        nonlocal at
        v = struct.unpack_from(kind, blob, at)[0]
        at += struct.calcsize(kind)
        return v

    def name() -> str:
        nonlocal at
        n = number()
        s = blob[at : at + n].decode()
        at += -(-n // 4) * 4
        return s

    def attributes() -> dict:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            key, kind, n = name(), number(), number()
            a = np.frombuffer(blob, _TYPES[kind], n, at)
            at += -(-a.nbytes // 4) * 4
            out[key] = a.tobytes().decode(errors="replace") if kind == 2 else a.tolist()[0] if n == 1 else a.tolist()
        return out

    records = number()
    number()
    dims = [(name(), number()) for _ in range(number())]
    attributes()
    number()
    heads = []
    for _ in range(number()):
        key = name()
        ids = [number() for _ in range(number())]
        heads.append((key, ids, attributes(), number(), number(), number(">Q" if wide else ">I")))
    is_record = [bool(ids) and dims[ids[0]][1] == 0 for _, ids, *_ in heads]
    sizes = [h[4] for h in heads]
    step = sum(s for s, r in zip(sizes, is_record) if r)
    out = {}
    for (key, ids, attrs, kind, size, begin), rec in zip(heads, is_record):
        shape = [dims[i][1] for i in ids]
        t = np.dtype(_TYPES[kind])
        if rec:
            n = int(np.prod(shape[1:], dtype=np.int64))
            data = np.stack([np.frombuffer(blob, t, n, begin + i * step) for i in range(records)]) if records else np.zeros((0, n), t)
            shape[0] = records
        else:
            data = np.frombuffer(blob, t, int(np.prod(shape, dtype=np.int64)), begin)
        out[key] = Variable(tuple(dims[i][0] for i in ids), data.reshape(shape), attrs)
    return out


def encode(variables: dict[str, Variable]) -> bytes:
    """A version 1 file with fixed dimensions."""
    sizes: dict[str, int] = {}
    for v in variables.values():
        for d, n in zip(v.dims, v.data.shape):
            if sizes.setdefault(d, n) != n:
                raise ValueError(f"dimension {d} has two sizes")
    order = list(sizes)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">I", len(s.encode())) + pad(s.encode())

    def attributes(a: dict) -> bytes:
        if not a:
            return struct.pack(">II", 0, 0)
        out = struct.pack(">II", _ATTS, len(a))
        for k, v in a.items():
            raw = v.encode() if isinstance(v, str) else struct.pack(">d", float(v))
            out += name(k) + struct.pack(">II", 2 if isinstance(v, str) else 6, len(raw) if isinstance(v, str) else 1) + pad(raw)
        return out

    kinds = {np.dtype(t).newbyteorder("="): k for k, t in _TYPES.items() if k != 2}
    head = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", _DIMS if order else 0, len(order)) + b"".join(name(d) + struct.pack(">I", sizes[d]) for d in order) + attributes({})
    raws = [pad(np.ascontiguousarray(v.data, _TYPES[kinds[v.data.dtype.newbyteorder("=")]]).tobytes()) for v in variables.values()]
    parts = [name(k) + struct.pack(">I", len(v.dims)) + b"".join(struct.pack(">I", order.index(d)) for d in v.dims) + attributes(v.attrs) + struct.pack(">II", kinds[v.data.dtype.newbyteorder("=")], len(r)) for (k, v), r in zip(variables.items(), raws)]
    at = len(head) + 8 + sum(len(p) + 4 for p in parts)
    head += struct.pack(">II", _VARS, len(parts))
    for p, r in zip(parts, raws):
        head += p + struct.pack(">I", at)
        at += len(r)
    return head + b"".join(raws)


def times(v: Variable) -> list[datetime]:
    """Timestamps of a CF time variable; only the standard calendars are known."""
    if v.attrs.get("calendar", "standard").lower() not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"calendar {v.attrs['calendar']} is not supported")
    unit, _, since = v.attrs["units"].partition(" since ")
    origin = datetime.fromisoformat(since.strip().replace("Z", "").split(".")[0].replace("T", " "))
    scale = {"days": 86400.0, "day": 86400.0, "hours": 3600.0, "hour": 3600.0, "minutes": 60.0, "seconds": 1.0}[unit.strip().lower()]
    return [origin + timedelta(seconds=float(x) * scale) for x in v.data]


def values(v: Variable) -> np.ndarray:
    """Doubles with fill values as NaN and scale and offset applied."""
    x = v.data.astype(np.float64)
    for k in ("_FillValue", "missing_value"):
        if k in v.attrs:
            x[v.data == v.attrs[k]] = np.nan
    return x * v.attrs.get("scale_factor", 1.0) + v.attrs.get("add_offset", 0.0)


def axis(dims: tuple[str, ...], names: tuple[str, ...]) -> int | None:
    return next((i for i, d in enumerate(dims) if d.lower() in names), None)


def read_cells(spark: SparkSession, path: str, variable: str | None = None, pattern: str = "*.nc") -> DataFrame:
    """``path, t, row, col, value`` of one variable of each file; other dimensions must have one entry.

    Without a name the emission rule chooses (see :func:`terracell.plans.emissions.choose_emission_variable`).
    """
    from ..plans.emissions import choose_emission_variable

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, blob in zip(frame["path"], frame["content"]):
                held = decode(bytes(blob))
                grids = {k: v for k, v in held.items() if axis(v.dims, LAT) is not None and axis(v.dims, LON) is not None}
                key = variable or choose_emission_variable({k: v.data.dtype.name for k, v in grids.items()})
                v = held[key]
                y, x, t = axis(v.dims, LAT), axis(v.dims, LON), axis(v.dims, TIME)
                if y is None or x is None:
                    raise ValueError(f"{key} has no latitude and longitude")
                a = values(v)
                front = [i for i in range(a.ndim) if i not in (y, x, t)]
                if any(a.shape[i] != 1 for i in front):
                    raise ValueError(f"{key} has further dimensions")
                a = a.transpose([*front, *([t] if t is not None else []), y, x]).reshape(-1, a.shape[y], a.shape[x])
                stamps = times(held[v.dims[t]]) if t is not None and v.dims[t] in held else [None] * len(a)
                rr, cc = np.indices(a.shape[1:])
                for at, plane in zip(stamps, a):
                    yield pd.DataFrame({"path": name, "t": pd.Series([at] * plane.size, dtype="datetime64[us]"), "row": rr.ravel().astype(np.int32), "col": cc.ravel().astype(np.int32), "value": plane.ravel()})

    out = files.mapInPandas(run, "path string, t timestamp_ntz, row int, col int, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
