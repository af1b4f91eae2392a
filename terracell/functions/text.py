"""Names, keys and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that a delimited file uses for a missing value (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Tokens of a missing number (fixed values, case matters).
NUMBER_GAPS = ("", "nan", "None")


def strip(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def null_tokens(s: Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    return F.when(~s.isin(*tokens), s)


def zfill(s: Column, width: Column | int) -> Column:
    """Zeros on the left up to ``width``, after a sign; never shorter."""
    w = F.lit(width) if isinstance(width, int) else width
    sign = F.when(F.substring(s, 1, 1).isin("+", "-"), F.substring(s, 1, 1)).otherwise(F.lit(""))
    body = s.substr(F.length(sign) + 1, F.length(s))
    return F.when(F.length(s) < w, F.concat(sign, F.repeat(F.lit("0"), (w - F.length(s)).cast("int")), body)).otherwise(s)


def decimal_comma(s: Column) -> Column:
    """Number with a decimal comma, and spaces or no-break spaces between thousands; anything else is NULL."""
    t = strip(s)
    t = F.when(~t.isin(*NUMBER_GAPS), t)
    for a, b in (("\u00a0", ""), (" ", ""), (",", ".")):
        t = F.replace(t, F.lit(a), F.lit(b))
    number = t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    infinite = F.lower(t).rlike(r"^[+-]?inf(inity)?$")
    return F.when(number, t.try_cast("double")).when(infinite, F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def to_number(s: Column) -> Column:
    """Plain number or NULL."""
    return F.when(s.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(s).try_cast("double"))


def safe_filename(s: Column, most: int = 150) -> Column:
    """Letters, digits, ``_ - .`` of any script; others become ``_``, and so does white space."""
    return F.substring(F.regexp_replace(F.regexp_replace(strip(s), r"(?U)[^\w\-\. ]+", "_"), r"(?U)\s+", "_"), 1, most)


def year_in_name(name: Column) -> Column:
    """First 19xx or 20xx in a name, NULL without."""
    y = F.regexp_extract(name, r"((?:19|20)[0-9]{2})", 1)
    return F.when(y != "", y.cast("int"))


def month_of_name(name: Column) -> Column:
    """``struct(year, month)`` of ``<anything>.<YYYYMM>-<YYYYMM>_cropped.nc``, by the first date; other names raise."""
    found = F.regexp_extract(name, r"(?i)^.*\.([0-9]{6})-[0-9]{6}_cropped\.nc$", 1)
    checked = F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no year and month in "), name)).cast("string"))
    return F.struct(F.substring(checked, 1, 4).cast("int").alias("year"), F.substring(checked, 5, 2).cast("int").alias("month"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    """Name without folder and last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def strip_tif(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(tif|tiff|TIF|TIFF)$", "")


def aligned_name(source: Column, target: Column, kind: str) -> Column:
    return F.concat(strip_tif(basename(source)), F.lit("_reprojected_to_"), strip_tif(basename(target)), F.lit(f"_grid__{kind}.tif"))


def export_name(band: Column, first: int, last: int) -> Column:
    return F.format_string(f"PT_%s_ERA5L_skinT_dailyMean_{first}_{last}_nativegrid", band)


def affine_of_wkt(wkt: Column) -> Column:
    """Six numbers from ``PARAMETER["elt_i_j", v]`` entries: scale x, shear x, origin x, shear y, scale y, origin y; shears default to 0."""
    keys = F.regexp_extract_all(wkt, F.lit(r'PARAMETER\["(elt_[0-9]_[0-9])",\s*([-+0-9.eE]+)\]'), F.lit(1))
    values = F.regexp_extract_all(wkt, F.lit(r'PARAMETER\["(elt_[0-9]_[0-9])",\s*([-+0-9.eE]+)\]'), F.lit(2))
    m = F.map_from_arrays(keys, F.transform(values, lambda v: v.try_cast("double")))
    get = lambda k, d=None: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(d)) if d is not None else F.try_element_at(m, F.lit(k))
    return F.array(get("elt_0_0"), get("elt_0_1", 0.0), get("elt_0_2"), get("elt_1_0", 0.0), get("elt_1_1"), get("elt_1_2"))
