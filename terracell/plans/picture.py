"""Choropleth pictures: features as classes of colour on a grid of pixels, written as PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import geometry as P
from ..model import GridSpec
from ..operators import vector as V

#: Colours from low to high, of features without a value and of the background (fixed values of this palette).
COLOURS = ((237, 248, 251), (178, 226, 226), (102, 194, 164), (44, 162, 95), (0, 109, 44))
MISSING, BACKGROUND = (211, 211, 211), (255, 255, 255)
#: Resolution in dots per inch (fixed value).
DPI = 200
#: Shares of a square picture: left, bottom, width and height of the mainland; left, width, top, bottom of the column of insets, and the gap between them (fixed values).
MAIN, INSETS = (0.33, 0.05, 0.64, 0.90), (0.05, 0.25, 0.92, 0.10, 0.02)
#: Side of such a picture in pixels, and the colour of the insets' borders.
SIDE, BORDER = 2000, (0, 0, 0)


def frame(features: DataFrame, width: int = 1200, geometry: str = "geometry") -> GridSpec:
    """A grid of square pixels around the features, with a margin of 5 %."""
    b = V.total_bounds(features, geometry).select(P.padded_bounds(F.struct("xmin", "ymin", "xmax", "ymax")).alias("b")).first()["b"]
    if b is None or b["xmin"] is None:
        raise ValueError("no features to draw")
    size = (b["xmax"] - b["xmin"]) / width
    return GridSpec.square("LOCAL", b["xmin"], b["ymax"], size, width, max(1, round((b["ymax"] - b["ymin"]) / size)))


def classes(features: DataFrame, value: str, grid: GridSpec, geometry: str = "geometry") -> DataFrame:
    """``row, col, class`` of the pixels inside features: 0 to 4 by quintile of the features' values, NULL without a value."""
    n = len(COLOURS)
    numbers = features.where(P.is_usable(F.col(geometry))).select(geometry, F.col(value).cast("double").alias("_value"))
    breaks = numbers.agg(F.percentile("_value", [i / n for i in range(1, n)]).alias("breaks"))
    pixels = V.mask_cells(numbers, grid, geometry, carry="_value")
    above = F.aggregate("breaks", F.lit(0), lambda k, b: k + F.when(F.col("_value") > b, 1).otherwise(0))
    return pixels.join(F.broadcast(breaks)).select("row", "col", F.when(F.col("_value").isNotNull(), above).alias("class"))


def png(rgb: np.ndarray, dpi: int = DPI) -> bytes:
    """A PNG file of a (rows, columns, 3) array of bytes."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    metre = round(dpi / 0.0254)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", metre, metre, 1)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def inset_frames(features: DataFrame, mainland: str | int, layer: str = "layer", geometry: str = "geometry", side: int = SIDE) -> DataFrame:
    """``layer, slot, x, y, width, height, scale, left, top``: where each layer goes in a picture of the mainland with insets.

    The largest layers beside the mainland get a slot each, one under another; later ones share slots.  ``x, y, width, height`` is the
    slot in pixels from the upper left corner, ``scale`` the units of a pixel, and a point has the column ``(px - left) / scale`` and the row ``(top - py) / scale``.  Insets
    keep a margin of 5 %.  One row for each layer.
    """
    f = features.where(P.is_usable(F.col(geometry)))
    boxes = f.select(F.col(layer), P.bounds(F.col(geometry)["polys"]).alias("b"))
    bounds = boxes.groupBy(layer).agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))
    islands = V.layer_slots(f.where(F.col(layer) != mainland), layer, P.area(F.col(geometry)["polys"])).select(F.col(layer).alias("_layer"), "slot")
    ranked = bounds.join(islands, bounds[layer] == islands["_layer"], "left").drop("_layer")
    slots = F.max(F.col("slot") + 1).over(Window.partitionBy(F.lit(1)))
    left, wide, top, bottom, gap = INSETS
    high = (F.lit(top - bottom) - (slots - 1) * gap) / slots
    main = F.col("slot").isNull()
    share = [F.when(main, F.lit(m)).otherwise(i) for m, i in zip((MAIN[0], 1 - MAIN[1] - MAIN[3], MAIN[2], MAIN[3]), (F.lit(left), 1 - top + F.col("slot") * (high + gap), F.lit(wide), high))]
    placed = ranked.select(layer, "slot", *[(c * side).alias(k) for c, k in zip(share, ("x", "y", "width", "height"))], F.struct("xmin", "ymin", "xmax", "ymax").alias("b"))
    placed = placed.withColumn("b", F.when(F.col("slot").isNull(), F.col("b")).otherwise(P.padded_bounds(F.col("b"))))
    b = F.col("b")
    scaled = placed.withColumn("scale", F.greatest((b["xmax"] - b["xmin"]) / F.col("width"), (b["ymax"] - b["ymin"]) / F.col("height")))
    middle = lambda lo, hi: (b[lo] + b[hi]) / 2
    return scaled.select(layer, "slot", "x", "y", "width", "height", "scale", (middle("xmin", "xmax") - (F.col("x") + F.col("width") / 2) * F.col("scale")).alias("left"), (middle("ymin", "ymax") + (F.col("y") + F.col("height") / 2) * F.col("scale")).alias("top"))


def placed_on_picture(features: DataFrame, frames: DataFrame, layer: str = "layer", geometry: str = "geometry") -> DataFrame:
    """Features with their corners in pixels, column and row, of the picture; frames are one row for each layer and are broadcast."""
    f = frames.select(F.col(layer).alias("_layer"), "scale", "left", "top")
    moved = P.transform_points(F.col(geometry), lambda x, y: ((x - F.col("left")) / F.col("scale"), (F.col("top") - y) / F.col("scale")))
    return features.join(F.broadcast(f), F.col(layer) == F.col("_layer")).withColumn(geometry, moved).drop("_layer", "scale", "left", "top")


def draw_with_insets(features: DataFrame, value: str, path: str, mainland: str | int, layer: str = "layer", geometry: str = "geometry", side: int = SIDE, dpi: int = DPI, overwrite: bool = False) -> bool:
    """The mainland and its islands in one picture, all layers by one scale of colours, with a border around each inset; see :func:`draw`."""
    spark = features.sparkSession
    if not overwrite and store.exists(spark, path):
        return False
    frames = inset_frames(features, mainland, layer, geometry, side)
    grid = GridSpec("LOCAL", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), side, side)
    image = _pixels(classes(placed_on_picture(features, frames, layer, geometry), value, grid, geometry), grid)
    for r in frames.where("slot is not null").select("x", "y", "width", "height").distinct().collect():
        x0, y0, x1, y1 = (min(side - 1, max(0, round(v))) for v in (r["x"], r["y"], r["x"] + r["width"], r["y"] + r["height"]))
        image[[y0, y1], x0 : x1 + 1] = image[y0 : y1 + 1, [x0, x1]] = len(COLOURS) + 2
    store.write_bytes(spark, path, [png(np.array([*COLOURS, MISSING, BACKGROUND, BORDER], np.uint8)[image], dpi)])
    return True


def _pixels(found: DataFrame, grid: GridSpec) -> np.ndarray:
    """One number for each pixel: its class, then missing, then background."""
    t = found.select("row", "col", F.coalesce("class", F.lit(len(COLOURS))).cast("int").alias("class")).toArrow()
    image = np.full((grid.height, grid.width), len(COLOURS) + 1)
    image[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column("class").to_numpy()
    return image


def draw(features: DataFrame, value: str, path: str, grid: GridSpec | None = None, geometry: str = "geometry", dpi: int = DPI, overwrite: bool = False) -> bool:
    """A choropleth as PNG in any store; False if it exists and ``overwrite`` is off.  The driver holds one class per pixel, so its size follows from the grid, not from the features."""
    spark = features.sparkSession
    if not overwrite and store.exists(spark, path):
        return False
    grid = grid or frame(features, geometry=geometry)
    image = _pixels(classes(features, value, grid, geometry), grid)
    store.write_bytes(spark, path, [png(np.array([*COLOURS, MISSING, BACKGROUND], np.uint8)[image], dpi)])
    return True
