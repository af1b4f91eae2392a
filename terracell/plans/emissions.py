"""Seasonal products from yearly emission files and from monthly concentration files, from discovery to grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..model import GridSpec
from ..operators.reproject import to_mollweide
from ..operators.temporal import HEATING_MONTHS, in_years, seasonal_products
from . import guards

#: Years covered, target resolutions in metres.
FIRST_YEAR, LAST_YEAR, EMISSION_M, CONCENTRATION_M = 2010, 2012, 10_000.0, 1_000.0
KEYS = ["row", "col"]


def choose_emission_variable(variables: dict[str, str]) -> str:
    """``res`` if there, else the first numeric variable, else the first; ``variables`` maps names to type names, in file order."""
    if not variables:
        raise ValueError("no variable")
    if "res" in variables:
        return "res"
    return next((n for n, t in variables.items() if is_numeric(t)), next(iter(variables)))


#: What the name of a concentration variable scores: pm25; pm_25 or pm2_5; pm (fixed values).
PM25_SCORES = (10, 9, 3)


def chosen_variables(variables: DataFrame, rule: str = "emission") -> DataFrame:
    """``path, name``: the variable that a rule (``emission`` or ``pm25``) takes of each file; ``variables``: ``path, position, name, dtype``.

    The same choice as :func:`choose_emission_variable` and :func:`choose_pm25_variable` make in one file.
    """
    if rule not in ("emission", "pm25"):
        raise ValueError(f"unknown rule {rule!r}")
    low, numeric = F.lower("name"), F.lower("dtype").rlike("int|float|double|short|byte|long|decimal")
    if rule == "emission":
        rank = F.struct(F.col("name") == "res", numeric, -F.col("position"))
    else:
        pm25, other, pm = ((c.cast("int") * k) for c, k in zip((low.contains("pm25"), low.contains("pm_25") | low.contains("pm2_5"), low.contains("pm")), PM25_SCORES))
        # Without a numeric variable the first one is taken, whatever its name.
        rank = F.struct(numeric, F.when(numeric, pm25 + other + pm), F.when(numeric, F.col("name")), -F.col("position"))
    return variables.groupBy("path").agg(F.max_by("name", rank).alias("name"))


def choose_pm25_variable(variables: dict[str, str], override: str | None = None) -> str:
    """The best-named numeric variable by (score, name), or the first without a numeric one."""
    if override is not None:
        if override not in variables:
            raise ValueError(f"no variable {override!r}")
        return override
    if not variables:
        raise ValueError("no variable")

    def score(name: str) -> int:
        n = name.lower()
        return sum(k * hit for k, hit in zip(PM25_SCORES, ("pm25" in n, "pm_25" in n or "pm2_5" in n, "pm" in n)))

    numeric = [n for n, t in variables.items() if is_numeric(t)]
    return max(numeric, key=lambda n: (score(n), n)) if numeric else next(iter(variables))


def is_numeric(type_name: str) -> bool:
    return any(x in type_name.lower() for x in ("int", "float", "double", "short", "byte", "long", "decimal"))


def emission_months(cells: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """``row, col, year, month, value`` in kg per square metre and month."""
    rows = cells.where(in_years(F.col("t"), first, last))
    return rows.select(*KEYS, F.year("t").alias("year"), F.month("t").alias("month"), clean.monthly_total(clean.mask_fill(F.col("value")), F.col("t")).alias("value"))


def concentration_months(cells: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    return cells.where(F.col("year").between(first, last)).select(*KEYS, "year", "month", clean.mask_low(F.col("value")).alias("value"))


def emissions(cells: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, check: bool = True) -> DataFrame:
    """``row, col, delta, average`` as 32-bit floats; a missing year or grids of several shapes stop the plan."""
    if check:
        years = cells.where(in_years(F.col("t"), first, last)).withColumn("year", F.year("t"))
        guards.require_none(guards.missing_years(years, first, last), "years")
        guards.require_one_shape(years, "year")
    out = seasonal_products(emission_months(cells, first, last), KEYS)
    return out.select(*KEYS, F.col("delta").cast("float").alias("delta"), F.col("average").cast("float").alias("average"))


def concentrations(cells: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, check: bool = True) -> DataFrame:
    """``row, col, delta, average`` as doubles; every year needs its heating months."""
    if check:
        guards.require_none(guards.missing_months(cells, first, last, HEATING_MONTHS), "months")
        guards.require_one_shape(cells.withColumn("_f", F.struct("year", "month")), "_f")
    return seasonal_products(concentration_months(cells, first, last), KEYS).select(*KEYS, "delta", "average")


def on_mollweide(product: DataFrame, src: GridSpec, resolution: float) -> tuple[DataFrame, GridSpec]:
    """Both products on one metric grid: ``layer, row, col, value``."""
    layers = product.unpivot(KEYS, ["delta", "average"], "layer", "value")
    return to_mollweide(layers, src, resolution, "nearest", ["layer"])
