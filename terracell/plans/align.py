"""Which of two rasters moves onto the other's grid, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import GridSpec, var_type
from ..operators import resample as R

#: (finer source, equal sizes) methods by variable type (fixed values).
_COARSEN = {"categorical": "mode", "binary": "mode", "continuous": "average", "share": "average", "count": "average"}
_REFINE = {"categorical": "nearest", "binary": "nearest", "continuous": "bilinear", "share": "bilinear", "count": "bilinear"}
_EQUAL = {"categorical": "nearest", "binary": "nearest", "count": "nearest", "continuous": "bilinear", "share": "bilinear"}
_REDUCER = {"count": "sum", "share": "mean", "continuous": "mean", "categorical": "mode", "binary": "mode"}


def resampling_for(kind: str, downsample: bool) -> str:
    return (_COARSEN if downsample else _REFINE)[var_type(kind)]


def equal_size_resampling(kind: str) -> str:
    return _EQUAL[var_type(kind)]


def reducer_for(kind: str) -> str:
    return _REDUCER[var_type(kind)]


def _map(table: dict[str, str], key: Column) -> tuple[Column, Column]:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key


def decisions(kind: Column, size: Column, target: Column, tol: float = 1e-6) -> Column:
    """``struct(method, reducer)`` for a layer of a variable type and cell size that goes onto a target's cell size: the tables above as columns.

    An unknown type has NULL in both.
    """
    known = F.coalesce(kind.isin(*_REDUCER), F.lit(False))
    equal, finer = F.abs(size - target) <= tol, size < target
    method = F.when(equal, F.try_element_at(*_map(_EQUAL, kind))).when(finer, F.try_element_at(*_map(_COARSEN, kind))).otherwise(F.try_element_at(*_map(_REFINE, kind)))
    return F.struct(F.when(known, method).alias("method"), F.when(known & finer & ~equal, F.try_element_at(*_map(_REDUCER, kind))).alias("reducer"))


def moved_label(size_a: float, size_b: float, prefer: str = "A_to_B", tol: float = 1e-6) -> tuple[str, str]:
    """(label of the raster that moves, relation): the finer one moves; equal sizes go by preference."""
    if prefer not in ("A_to_B", "B_to_A"):
        raise ValueError(f"unknown preference {prefer!r}")
    if abs(size_a - size_b) <= tol:
        return ("A" if prefer == "A_to_B" else "B"), "equal"
    return ("A", "finer") if size_a < size_b else ("B", "finer")


def move(cells: DataFrame, src: GridSpec, dst: GridSpec, kind: str, relation: str, integer: bool = False, exact: bool = False) -> DataFrame:
    """Cells of ``src`` on ``dst`` by the rules of a variable type."""
    if relation == "equal":
        return R.regrid(cells, src, dst, equal_size_resampling(kind))
    if var_type(kind) == "count":
        return R.regrid_counts(cells, src, dst, integer, exact)
    return R.regrid(cells, src, dst, resampling_for(kind, downsample=True))


def align_two(a: DataFrame, grid_a: GridSpec, kind_a: str, b: DataFrame, grid_b: GridSpec, kind_b: str, prefer: str = "A_to_B", tol: float = 1e-6,
              exact: bool = False) -> tuple[DataFrame, str]:
    """(moved cells, "A" or "B"): sizes are compared along x only; the grids must share their CRS."""
    var_type(kind_a), var_type(kind_b)
    if grid_a.crs != grid_b.crs:
        raise ValueError("the grids have different CRS")
    label, relation = moved_label(grid_a.res_x, grid_b.res_x, prefer, tol)
    moving = (a, grid_a, grid_b, kind_a) if label == "A" else (b, grid_b, grid_a, kind_b)
    return move(*moving, relation, exact=exact), label


def align_to_grid(cells: DataFrame, src: GridSpec, dst: GridSpec, kind: str, reduce: bool = True, tol: float = 1e-6) -> DataFrame:
    """The catalog flavour: a finer source is reduced by type (counts are summed and conserved), others are sampled."""
    if reduce and dst.cell_size - src.cell_size > tol:
        return R.reduce_cells(cells, src, dst, reducer_for(kind))
    return R.regrid(cells, src, dst, equal_size_resampling(kind))


def align_two_by_catalog(a: DataFrame, grid_a: GridSpec, kind_a: str, b: DataFrame, grid_b: GridSpec, kind_b: str, prefer: str = "A_to_B", tol: float = 1e-6) -> tuple[DataFrame, str]:
    label, _ = moved_label(grid_a.cell_size, grid_b.cell_size, prefer, tol)
    return (align_to_grid(a, grid_a, grid_b, kind_a, tol=tol), label) if label == "A" else (align_to_grid(b, grid_b, grid_a, kind_b, tol=tol), label)
