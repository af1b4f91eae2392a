"""Missing values, units and point transforms; every bad value becomes NULL on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fill threshold, lowest valid concentration, seconds of a day, zero Celsius in Kelvin, NoData of night lights.
FILL, LOWEST, DAY_SECONDS, ZERO_CELSIUS, LIGHTS_NODATA = 1e20, -100.0, 86400.0, 273.15, -9999.0


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def no_nan(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def mask_fill(v: Column, limit: float = FILL) -> Column:
    """Values of the threshold or more are missing, and so is NaN."""
    return F.when(~F.isnan(v) & (v < limit), v)


def mask_low(v: Column, low: float = LOWEST) -> Column:
    """Values below ``low`` are missing, ``low`` itself is not; NaN is."""
    return F.when(~F.isnan(v) & (v >= low), v)


def month_days(t: Column) -> Column:
    return F.dayofmonth(F.last_day(t.cast("date")))


def monthly_total(rate: Column, t: Column) -> Column:
    """A rate per second times the seconds of the month of ``t``, leap years included."""
    return rate * month_days(t) * F.lit(DAY_SECONDS)


def celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(ZERO_CELSIUS)


def lights_log(v: Column, nodata: float | None = LIGHTS_NODATA, source_nodata: float | None = None) -> Column:
    """``ln(v + 2)`` where ``v`` is finite, no NoData and above -2, else NULL.

    By default only the output's NoData is recognised; ``source_nodata`` adds the input's own.
    """
    ok = finite(v) & (v + 2 > 0)
    for bad in (LIGHTS_NODATA if nodata is None or nodata != nodata else nodata, source_nodata):
        if bad is not None:
            ok = ok & (v != bad)
    return F.when(ok, F.log(F.when(v + 2 > 0, v + 2)))


def on_band(band: Column, wanted: int, changed: Column, value: Column) -> Column:
    """``changed`` on one band, ``value`` on the others."""
    return F.when(band == wanted, changed).otherwise(value)


def encode_nodata(v: Column, nodata: float = LIGHTS_NODATA) -> Column:
    return F.coalesce(v, F.lit(nodata)).cast("float")


def rint_long(v: Column) -> Column:
    """Half to even."""
    return F.rint(v).cast("long")


def outside_share(condition: Column, value: Column) -> Column:
    """1 where the condition holds, 0 where it does not, NULL where the value is missing."""
    return F.when(value.isNull(), None).when(condition, 1).otherwise(0)
