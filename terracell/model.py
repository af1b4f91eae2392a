"""Data model: rasters as long tables of cells, one catalog row per grid, features as nested rings.

NoData is NULL everywhere, never NaN.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampNTZType

CELLS = StructType([
    StructField("layer", StringType()), StructField("band", IntegerType()), StructField("t", TimestampNTZType()),
    StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("value", DoubleType()),
])
POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
#: polygon -> ring -> point; the first ring of a polygon is its shell, the others are holes.
POLYGONS = ArrayType(ArrayType(ArrayType(POINT)))
GEOMETRY = StructType([StructField("type", StringType()), StructField("polys", POLYGONS)])
FEATURES = StructType([StructField("dicofre", StringType()), StructField("crs", StringType()), StructField("geometry", GEOMETRY)])

#: What a band measures; decides how it may be resampled.
VAR_TYPES = ("count", "share", "continuous", "categorical", "binary")


def var_type(name: str) -> str:
    if name not in VAR_TYPES:
        raise ValueError(f"unknown variable type {name!r}; one of {', '.join(VAR_TYPES)}")
    return name


@dataclass(frozen=True)
class GridSpec:
    """A north-up or rotated grid: ``x = c + a*col + b*row``, ``y = f + d*col + e*row`` with transform ``(a, b, c, d, e, f)``."""

    crs: str
    transform: tuple[float, float, float, float, float, float]
    width: int
    height: int

    def __post_init__(self):
        if not self.crs:
            raise ValueError("a grid needs a CRS")
        if self.width < 1 or self.height < 1 or self.res_x == 0 or self.res_y == 0:
            raise ValueError("a grid needs cells of some size")

    @property
    def res_x(self) -> float:
        return abs(self.transform[0])

    @property
    def res_y(self) -> float:
        return abs(self.transform[4])

    @property
    def cell_size(self) -> float:
        return min(self.res_x, self.res_y)

    @property
    def cell_area(self) -> float:
        return self.res_x * self.res_y

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax over the four corners."""
        a, b, c, d, e, f = self.transform
        xs = [c + a * i + b * j for i in (0, self.width) for j in (0, self.height)]
        ys = [f + d * i + e * j for i in (0, self.width) for j in (0, self.height)]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def resolution(self) -> str:
        """``x x y`` with up to six significant digits, as in a manifest."""
        return f"{self.res_x:g} x {self.res_y:g}"

    def to_dict(self) -> dict:
        return asdict(self) | {"bounds": self.bounds, "res_x": self.res_x, "res_y": self.res_y}

    @staticmethod
    def of(x: "GridSpec | dict") -> "GridSpec":
        return x if isinstance(x, GridSpec) else GridSpec(x["crs"], tuple(x["transform"]), int(x["width"]), int(x["height"]))

    @staticmethod
    def square(crs: str, x0: float, y0: float, size: float, width: int, height: int, up: bool = True) -> "GridSpec":
        """A grid with square cells; ``up``: rows go down from the top edge ``y0``."""
        return GridSpec(crs, (size, 0.0, x0, 0.0, -size if up else size, y0), width, height)
