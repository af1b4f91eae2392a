"""Columns of embedding tables that the operators on vectors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components up to this size fit a long and are whole numbers as doubles.
EXACT = float(1 << 53)


def finite(vector: Column) -> Column:
    """Not null, and neither null nor NaN nor infinite anywhere."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda v: F.coalesce(bad(v), F.lit(True))), F.lit(False))


def scaled(vector: Column, factor: float, shift: int = 0, limit: float = EXACT) -> Column:
    """``floor(factor * x) + shift`` of each component as longs; a component beyond ``limit`` raises, as what follows could not be exact."""

    def one(v: Column) -> Column:
        x = F.lit(float(factor)) * v.cast("double")
        return F.when(F.abs(x) <= limit, F.floor(x) + F.lit(shift).cast("long")).otherwise(F.raise_error(F.concat(F.lit("a component is too large for whole numbers: "), v.cast("string"))).cast("long"))

    return F.transform(vector, one)


def usable(rows: DataFrame, vec_id: str, vector: str, dims: int | None = None) -> DataFrame:
    """``vec_id, vector`` of the rows with a finite vector, of ``dims`` components if given; other columns are left behind."""
    v = F.col(vector)
    keep = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector")).where(finite(F.col("vector")))
    return keep if dims is None else keep.where(F.size("vector") == dims)
