"""Map projections of coordinate reference systems as chains of column expressions.

A CRS, by code or as WKT, becomes an ellipsoid, a datum shift and a projection.  Each of these is a step that maps columns to columns; a chain
from one CRS to another goes through longitude and latitude on WGS84.  Steps are bound one after another (:func:`on_columns`, :func:`on_frame`), so an
expression that a later step uses often is computed once.

Latitudes of equal area and of equal angles are converted by sine series whose coefficients are computed here for each
ellipsoid; six terms leave less than a micrometre.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mollweide

Step = Callable[..., tuple[Column, ...]]

#: Terms of a series between latitudes.
TERMS = 6
#: Axes and inverse flattenings of ellipsoids (fixed values).
WGS84, GRS80, INTERNATIONAL = (6378137.0, 298.257223563), (6378137.0, 298.257222101), (6378388.0, 297.0)


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float  # 0: a sphere

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening if self.inverse_flattening else 0.0
        return f * (2 - f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    def q(self, s: float) -> float:
        """Snyder's q of the sine of a latitude: area between it and the equator."""
        return 2 * s if not self.e2 else (1 - self.e2) * (s / (1 - self.e2 * s * s) + math.atanh(self.e * s) / self.e)

    def isometric(self, lat: float) -> float:
        s = math.sin(lat)
        return math.asinh(math.tan(lat)) - self.e * math.atanh(self.e * s)

    def m(self, lat: float) -> float:
        """Radius of a parallel over the major axis."""
        return math.cos(lat) / math.sqrt(1 - self.e2 * math.sin(lat) ** 2)

    def authalic(self, lat: float) -> float:
        return math.asin(max(-1.0, min(1.0, self.q(math.sin(lat)) / self.q(1.0))))

    def conformal(self, lat: float) -> float:
        return lat if abs(lat) >= math.pi / 2 else math.atan(math.sinh(self.isometric(lat)))

    @functools.cached_property
    def to_authalic(self) -> list[float]:
        return _coefficients(self.authalic, False)

    @functools.cached_property
    def from_authalic(self) -> list[float]:
        return _coefficients(self.authalic, True)

    @functools.cached_property
    def from_conformal(self) -> list[float]:
        return _coefficients(self.conformal, True)


def _coefficients(auxiliary: Callable[[float], float], back: bool) -> list[float]:
    """c with ``other = lat + sum(c[k] * sin(2(k+1)lat))``, by quadrature over a quarter turn; ``back``: from the auxiliary latitude."""
    n = 64
    at = (np.arange(n) + 0.5) * (math.pi / 2 / n)
    if back:
        lat = at.copy()
        for _ in range(50):  # a fixed point: the two latitudes differ by a small, smooth function
            lat = at - np.array([auxiliary(x) for x in lat]) + lat
        gap = lat - at
    else:
        gap = np.array([auxiliary(x) for x in at]) - at
    return [float(2 / n * (gap * np.sin(2 * (k + 1) * at)).sum()) for k in range(TERMS)]


def _sines(lat: Column, c: list[float]) -> Column:
    out = lat
    for k, v in enumerate(c):
        if abs(v) > 1e-17:
            out = out + F.sin(lat * (2 * (k + 1))) * v
    return out


def _atanh_e(e: Ellipsoid, s: Column) -> Column:
    return F.atanh(s * e.e) * e.e if e.e2 else F.lit(0.0)


def _asinh(x: Column) -> Column:
    """Odd in x: Spark's own loses the small side of negative numbers."""
    return F.signum(x) * F.asinh(F.abs(x))


def _isometric(e: Ellipsoid, s: Column) -> Column:
    """Isometric latitude of the sine of a latitude."""
    return F.atanh(s) - _atanh_e(e, s)


def _wrap(d: Column) -> Column:
    """Radians between -pi and pi."""
    return d - F.floor(d / (2 * math.pi) + 0.5) * (2 * math.pi)


@dataclass(frozen=True)
class Projection:
    """Steps from radians to units of the major axis, without false origin, and back; longitudes are from the central meridian."""

    forward: list[Step]
    inverse: list[Step]


def _transverse_mercator(e: Ellipsoid, p: dict[str, float]) -> Projection:
    f = 1 / e.inverse_flattening if e.inverse_flattening else 0.0
    n = f / (2 - f)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    to = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    xi0 = e.conformal(p["lat0"])
    y0 = xi0 + sum(c * math.sin(2 * (k + 1) * xi0) for k, c in enumerate(to))
    k0 = p["k"] * radius

    def add(u: Column, v: Column, c: tuple[float, ...]) -> tuple[Column, Column]:
        """Sums of the series in u + iv, real and imaginary part."""
        x, y = u, v
        for k, w in enumerate(c):
            x = x + F.sin(u * (2 * (k + 1))) * F.cosh(v * (2 * (k + 1))) * w
            y = y + F.cos(u * (2 * (k + 1))) * F.sinh(v * (2 * (k + 1))) * w
        return x, y

    def scaled(u: Column, v: Column) -> tuple[Column, Column]:
        x, y = add(u, v, to)
        return y * k0, (x - y0) * k0

    def unscaled(x: Column, y: Column) -> tuple[Column, Column]:
        return y / k0 + y0, x / k0

    return Projection(
        [lambda lon, lat: (lon, F.sin(lat)), lambda lon, s: (lon, F.sinh(_isometric(e, s))),
         lambda lon, t: (F.atan2(t, F.cos(lon)), _asinh(F.sin(lon) / F.sqrt(t * t + F.cos(lon) * F.cos(lon)))), scaled],
        [unscaled, lambda u, v: add(u, v, tuple(-c for c in back)),
         lambda u, v: (F.atan2(F.sinh(v), F.cos(u)), F.asin(F.sin(u) / F.cosh(v))), lambda lon, chi: (lon, _sines(chi, e.from_conformal))],
    )


def _azimuthal_equal_area(e: Ellipsoid, p: dict[str, float]) -> Projection:
    b0, r = e.authalic(p["lat0"]), math.sqrt(e.q(1.0) / 2)
    s0, c0 = math.sin(b0), math.cos(b0)
    d = 1.0 if abs(c0) < 1e-9 else e.m(p["lat0"]) / (r * c0)

    def forward(lon: Column, b: Column) -> tuple[Column, ...]:
        return F.cos(b) * F.sin(lon), F.sin(b), F.cos(b) * F.cos(lon)

    def plane(east: Column, up: Column, ahead: Column) -> tuple[Column, ...]:
        scale = F.sqrt(F.try_divide(F.lit(2.0), 1 + up * s0 + ahead * c0)) * r
        return scale * d * east, scale / d * (up * c0 - ahead * s0)

    def half(x: Column, y: Column) -> tuple[Column, ...]:
        u, v = x / d, y * d
        return u, v, (u * u + v * v) / (4 * r * r)

    def sphere(u: Column, v: Column, h: Column) -> tuple[Column, ...]:
        # cos c = 1 - 2h and sin c = rho * k, so nothing is divided by a distance of zero; outside the circle the root is NaN.
        k, cos = F.sqrt(F.when(h <= 1, 1 - h)) / r, 1 - h * 2
        return F.atan2(u * k, cos * c0 - v * k * s0), F.asin(F.least(F.greatest(cos * s0 + v * k * c0, F.lit(-1.0)), F.lit(1.0)))

    return Projection([lambda lon, lat: (lon, _sines(lat, e.to_authalic)), forward, plane], [half, sphere, lambda lon, b: (lon, _sines(b, e.from_authalic))])


def _conic(n: float, r0: float, radius: Callable[[Column], Column], latitude: Callable[[Column], Column], prepare: Step) -> Projection:
    """A conic with the cone constant ``n``; ``radius`` of a prepared latitude, ``latitude`` of a radius."""
    side = math.copysign(1.0, n)
    return Projection(
        [prepare, lambda lon, t: (lon * n, radius(t)), lambda th, r: (r * F.sin(th), F.lit(r0) - r * F.cos(th))],
        [lambda x, y: (x * side, (F.lit(r0) - y) * side), lambda x, y: (F.atan2(x, y) / n, latitude(F.sqrt(x * x + y * y) * side))],
    )


def _conformal_conic(e: Ellipsoid, p: dict[str, float]) -> Projection:
    one, two = p["lat1"], p["lat2"]
    n = math.sin(one) if abs(one - two) < 1e-12 else (math.log(e.m(one)) - math.log(e.m(two))) / (e.isometric(two) - e.isometric(one))
    scale = p["k"] * e.m(one) / n * math.exp(n * e.isometric(one))
    radius = lambda psi: F.exp(psi * -n) * scale
    conformal = lambda r: F.atan(F.sinh(F.log(F.try_divide(F.lit(scale), r)) / n))
    pole = abs(abs(p["lat0"]) - math.pi / 2) < 1e-12
    conic = _conic(n, 0.0 if pole else scale * math.exp(-n * e.isometric(p["lat0"])), radius, conformal, lambda lon, lat: (lon, _isometric(e, F.sin(lat))))
    return Projection(conic.forward, [*conic.inverse, lambda lon, chi: (lon, _sines(chi, e.from_conformal))])


def _equal_area_conic(e: Ellipsoid, p: dict[str, float]) -> Projection:
    one, two = p["lat1"], p["lat2"]
    q1, q2, qp = e.q(math.sin(one)), e.q(math.sin(two)), e.q(1.0)
    n = math.sin(one) if abs(one - two) < 1e-12 else (e.m(one) ** 2 - e.m(two) ** 2) / (q2 - q1)
    c = e.m(one) ** 2 + n * q1
    radius = lambda b: F.sqrt(c - F.sin(b) * (n * qp)) / n
    authalic = lambda r: F.asin(F.least(F.greatest((c - r * r * n * n) / (n * qp), F.lit(-1.0)), F.lit(1.0)))
    conic = _conic(n, math.sqrt(c - n * e.q(math.sin(p["lat0"]))) / n, radius, authalic, lambda lon, lat: (lon, _sines(lat, e.to_authalic)))
    return Projection(conic.forward, [*conic.inverse, lambda lon, b: (lon, _sines(b, e.from_authalic))])


def _mercator(e: Ellipsoid, p: dict[str, float]) -> Projection:
    k = p["k"] * e.m(p["lat1"])
    return Projection(
        [lambda lon, lat: (lon * k, _isometric(e, F.sin(lat)) * k)],
        [lambda x, y: (x / k, F.atan(F.sinh(y / k))), lambda lon, chi: (lon, _sines(chi, e.from_conformal))],
    )


def _web_mercator(e: Ellipsoid, p: dict[str, float]) -> Projection:
    return _mercator(Ellipsoid(e.a, 0.0), p)


def _cylindrical_equal_area(e: Ellipsoid, p: dict[str, float]) -> Projection:
    k, qp = p["k"] * e.m(p["lat1"]), e.q(1.0)
    return Projection(
        [lambda lon, lat: (lon * k, F.sin(_sines(lat, e.to_authalic)) * (qp / 2 / k))],
        [lambda x, y: (x / k, F.asin(F.when(F.abs(y) <= qp / 2 / k * (1 + 1e-12), F.least(F.greatest(y * (2 * k / qp), F.lit(-1.0)), F.lit(1.0))))), lambda lon, b: (lon, _sines(b, e.from_authalic))],
    )


def _polar_stereographic(e: Ellipsoid, p: dict[str, float]) -> Projection:
    south = p["lat0"] < 0 or (p["lat0"] == 0 and p["lat1"] < 0)
    side = -1.0 if south else 1.0
    at_pole = 2 / math.sqrt((1 + e.e) ** (1 + e.e) * (1 - e.e) ** (1 - e.e))
    true = abs(p["lat1"])
    scale = at_pole * p["k"] if true in (0.0, math.pi / 2) else e.m(true) * math.exp(e.isometric(true))
    return Projection(
        [lambda lon, lat: (lon, F.exp(_isometric(e, F.sin(lat)) * -side) * scale), lambda lon, r: (r * F.sin(lon), r * F.cos(lon) * -side)],
        [lambda x, y: (F.atan2(x, y * -side), F.atan(F.sinh(F.log(F.try_divide(F.lit(scale), F.sqrt(x * x + y * y))))) * side),
         lambda lon, chi: (lon, F.coalesce(_sines(chi, e.from_conformal), F.lit(side * math.pi / 2)))],
    )


def _sinusoidal(e: Ellipsoid, p: dict[str, float]) -> Projection:
    if e.e2:
        raise ValueError("the sinusoidal projection is for spheres")
    ok = lambda lon, lat: (F.abs(lat) <= math.pi / 2) & (F.abs(lon) <= math.pi * (1 + 1e-12))
    return Projection([lambda lon, lat: (lon * F.cos(lat), lat)], [lambda x, y: (F.try_divide(x, F.cos(y)), y), lambda lon, lat: (F.when(ok(lon, lat), lon), F.when(ok(lon, lat), lat))])


def _equirectangular(e: Ellipsoid, p: dict[str, float]) -> Projection:
    k = math.cos(p["lat1"])
    return Projection([lambda lon, lat: (lon * k, lat)], [lambda x, y: (x / k, y)])


def _mollweide(e: Ellipsoid, p: dict[str, float]) -> Projection:
    unit = mollweide.RADIUS

    def forward(lon: Column, lat: Column) -> tuple[Column, ...]:
        x, y = mollweide.forward(F.degrees(lon), F.degrees(lat))
        return x / unit, y / unit

    def inverse(x: Column, y: Column) -> tuple[Column, ...]:
        lon, lat = mollweide.inverse(x * unit, y * unit)
        return F.radians(lon), F.radians(lat)

    return Projection([forward], [inverse])


#: Names of projections in WKT and in PROJ strings, without marks and in lower case (fixed values).
_METHODS = {
    "transversemercator": _transverse_mercator, "tmerc": _transverse_mercator, "gausskruger": _transverse_mercator,
    "lambertazimuthalequalarea": _azimuthal_equal_area, "laea": _azimuthal_equal_area,
    "lambertconformalconic2sp": _conformal_conic, "lambertconformalconic1sp": _conformal_conic, "lambertconformalconic": _conformal_conic, "lambertconicconformal2sp": _conformal_conic,
    "lambertconicconformal1sp": _conformal_conic, "lcc": _conformal_conic,
    "albersconicequalarea": _equal_area_conic, "albersequalarea": _equal_area_conic, "albers": _equal_area_conic, "aea": _equal_area_conic,
    "mercator1sp": _mercator, "mercator2sp": _mercator, "mercatorvarianta": _mercator, "mercatorvariantb": _mercator, "mercator": _mercator, "merc": _mercator,
    "popularvisualisationpseudomercator": _web_mercator, "mercatorauxiliarysphere": _web_mercator,
    "cylindricalequalarea": _cylindrical_equal_area, "lambertcylindricalequalarea": _cylindrical_equal_area, "cea": _cylindrical_equal_area,
    "polarstereographic": _polar_stereographic, "polarstereographicvarianta": _polar_stereographic, "polarstereographicvariantb": _polar_stereographic, "stere": _polar_stereographic,
    "sinusoidal": _sinusoidal, "sinu": _sinusoidal, "mollweide": _mollweide, "moll": _mollweide,
    "equirectangular": _equirectangular, "equidistantcylindrical": _equirectangular, "platecarree": _equirectangular, "eqc": _equirectangular,
}
#: Names of parameters in WKT and in PROJ strings, likewise (fixed values).
_PARAMETERS = {
    "latitudeoforigin": "lat0", "latitudeofcenter": "lat0", "latitudeofnaturalorigin": "lat0", "latitudeoffalseorigin": "lat0", "lat0": "lat0",
    "centralmeridian": "lon0", "longitudeofcenter": "lon0", "longitudeoforigin": "lon0", "longitudeofnaturalorigin": "lon0", "longitudeoffalseorigin": "lon0", "longitudeofcentre": "lon0", "lon0": "lon0",
    "latitudeofcentre": "lat0", "straightverticallongitudefrompole": "lon0",
    "standardparallel1": "lat1", "latitudeof1ststandardparallel": "lat1", "latitudeofstandardparallel": "lat1", "lat1": "lat1", "latts": "lat1",
    "standardparallel2": "lat2", "latitudeof2ndstandardparallel": "lat2", "lat2": "lat2",
    "scalefactor": "k", "scalefactoratnaturalorigin": "k", "k": "k", "k0": "k",
    "falseeasting": "east", "eastingatfalseorigin": "east", "x0": "east", "falsenorthing": "north", "northingatfalseorigin": "north", "y0": "north",
}


@dataclass(frozen=True)
class Crs:
    """Ellipsoid, projection (none: longitude and latitude in degrees), parameters in degrees and metres, shift to WGS84 and size of a unit in metres or degrees."""

    ellipsoid: tuple[float, float] = WGS84
    method: str | None = None
    parameters: dict[str, float] = field(default_factory=dict)
    #: Translation in metres, rotation in arc seconds (position vector) and scale in parts per million.
    shift: tuple[float, ...] = ()
    unit: float = 1.0
    meridian: float = 0.0

    def _parts(self) -> tuple[Ellipsoid, Projection | None, float, float, float]:
        e, p = Ellipsoid(*self.ellipsoid), dict(self.parameters)
        if self.method is None:
            return e, None, 0.0, 0.0, 0.0
        if self.method not in _METHODS:
            raise ValueError(f"the projection {self.method!r} is not supported")
        one_parallel = "lat1" not in p and _METHODS[self.method] is _conformal_conic
        lat0 = p.get("lat0", 0.0)
        lat1 = lat0 if one_parallel else p.get("lat1", 0.0)
        at = {"lat0": math.radians(lat0), "lat1": math.radians(lat1), "lat2": math.radians(lat1 if one_parallel else p.get("lat2", lat1)), "k": p.get("k", 1.0)}
        return e, _METHODS[self.method](e, at), p.get("lon0", 0.0), p.get("east", 0.0), p.get("north", 0.0)

    def forward(self) -> list[Step]:
        """Steps from longitude and latitude in degrees on WGS84; NULL where the projection has no place for them."""
        e, projection, lon0, east, north = self._parts()
        steps = self._shifted(True)
        if projection is None:
            return [*steps, lambda lon, lat: ((lon - self.meridian) / self.unit, lat / self.unit)] if self.unit != 1 or self.meridian else steps
        near = lambda lon, lat: (_wrap(F.radians(lon - (lon0 + self.meridian))), F.radians(F.when(F.abs(lat) <= 90, lat)))
        place = lambda x, y: ((_finite(x) * e.a + east) / self.unit, (_finite(y) * e.a + north) / self.unit)
        return [*steps, near, *projection.forward, place]

    def inverse(self) -> list[Step]:
        """Steps to longitude and latitude in degrees on WGS84."""
        e, projection, lon0, east, north = self._parts()
        if projection is None:
            first = [lambda x, y: (x * self.unit + self.meridian, y * self.unit)] if self.unit != 1 or self.meridian else []
            return [*first, *self._shifted(False)]
        origin = lambda x, y: ((x * self.unit - east) / e.a, (y * self.unit - north) / e.a)
        degrees = lambda lon, lat: (F.degrees(_finite(lon)) + (lon0 + self.meridian), F.degrees(_finite(lat)))
        return [origin, *projection.inverse, degrees, *self._shifted(False)]

    def _shifted(self, from_wgs84: bool) -> list[Step]:
        """Datum shift over geocentric coordinates at height 0; the way back is corrected once, so that both ways undo each other."""
        if not any(self.shift):
            return []
        own, world = Ellipsoid(*self.ellipsoid), Ellipsoid(*WGS84)
        tx, ty, tz, rx, ry, rz, ppm = (*self.shift, *[0.0] * 7)[:7]
        rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
        m = 1 + ppm * 1e-6

        def to_world(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
            return (x - y * rz + z * ry) * m + tx, (x * rz + y - z * rx) * m + ty, (y * rx - x * ry + z) * m + tz

        def from_world(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
            x, y, z = (x - tx) / m, (y - ty) / m, (z - tz) / m
            return x + y * rz - z * ry, y + z * rx - x * rz, z + x * ry - y * rx

        there = [functools.partial(_geocentric, own), to_world, functools.partial(_geodetic, world)]
        if not from_wgs84:
            return there
        back = [functools.partial(_geocentric, world), from_world, functools.partial(_geodetic, own)]

        def corrected(lon: Column, lat: Column) -> tuple[Column, ...]:
            a, b = on_columns(back, lon, lat)
            again = on_columns(there, a, b)
            return a + (lon - again[0]), b + (lat - again[1])

        return [corrected]


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _geocentric(e: Ellipsoid, lon: Column, lat: Column) -> tuple[Column, ...]:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(e.a) / F.sqrt(1 - s * s * e.e2)
    return n * c * F.cos(F.radians(lon)), n * c * F.sin(F.radians(lon)), n * (1 - e.e2) * s


def _geodetic(e: Ellipsoid, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Degrees of a point near the ellipsoid by Bowring's formula, whose error is far below a micrometre there."""
    p, b = F.sqrt(x * x + y * y), e.a * math.sqrt(1 - e.e2)
    t = F.atan2(z * e.a, p * b)
    s, c = F.sin(t), F.cos(t)
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z + s * s * s * (e.e2 / (1 - e.e2) * b), p - c * c * c * (e.e2 * e.a)))


def on_columns(steps: list[Step], x: Column, y: Column) -> tuple[Column, Column]:
    """The end of a chain as two columns; each step's results are bound by a lambda, so this also works inside other lambdas."""

    def bind(values: tuple[Column, ...], rest: list[Step]) -> Column:
        if not rest:
            return F.struct(values[0].cast("double").alias("x"), values[1].cast("double").alias("y"))
        held = F.array(F.struct(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)]))
        return F.get(F.transform(held, lambda h: bind(rest[0](*[h[f"v{i}"] for i in range(len(values))]), rest[1:])), F.lit(0))

    out = bind((x, y), list(steps))
    return out["x"], out["y"]


def on_frame(df: DataFrame, steps: list[Step], pairs: list[tuple[str, str]]) -> DataFrame:
    """``df`` with each pair of columns at the end of a chain; each step is a projection of its own, which keeps to generated code.

    Filters on the results stay behind them (:func:`settled`): the optimizer would else write the whole chain out once for each use of a column.
    """
    keep = [c for c in df.columns if c not in {n for p in pairs for n in p}]
    names = [[x, y] for x, y in pairs]
    for number, step in enumerate(steps):
        made, after = [], []
        for i, n in enumerate(names):
            values = step(*[F.col(f"`{c}`") for c in n])
            after.append([f"_p{number}_{i}_{k}" for k in range(len(values))])
            made += [v.cast("double").alias(a) for v, a in zip(values, after[-1])]
        df, names = df.select(*[F.col(f"`{c}`") for c in keep], *made), after
    if not steps:
        return df
    return df.select(*[F.col(f"`{c}`") for c in keep], *[settled(F.col(n[k])).alias(p[k]) for n, p in zip(names, pairs) for k in (0, 1)])


def settled(value: Column) -> Column:
    """The value as it is, in a form that no filter is pushed through."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


# --- names and WKT ----------------------------------------------------------------------------------------------------

#: Systems by code: parameters of the national and continental grids that the data come in (fixed values).
_KNOWN = {
    "EPSG:4326": Crs(), "OGC:CRS84": Crs(), "URN:OGC:DEF:CRS:OGC:1.3:CRS84": Crs(), "EPSG:4258": Crs(GRS80), "EPSG:4979": Crs(),
    "EPSG:3035": Crs(GRS80, "laea", {"lat0": 52.0, "lon0": 10.0, "east": 4321000.0, "north": 3210000.0}),
    "EPSG:3034": Crs(GRS80, "lcc", {"lat0": 52.0, "lon0": 10.0, "lat1": 35.0, "lat2": 65.0, "east": 4000000.0, "north": 2800000.0}),
    "EPSG:3763": Crs(GRS80, "tmerc", {"lat0": 39.66825833333333, "lon0": -8.133108333333334}),
    "EPSG:27493": Crs(INTERNATIONAL, "tmerc", {"lat0": 39.66666666666666, "lon0": -8.131906111111112, "east": 180.598, "north": -86.99}, (-223.237, 110.193, 36.649)),
    "EPSG:3857": Crs(WGS84, "popularvisualisationpseudomercator"), "EPSG:3395": Crs(WGS84, "merc"),
    "EPSG:6933": Crs(WGS84, "cea", {"lat1": 30.0}), "EPSG:5070": Crs(GRS80, "aea", {"lat0": 23.0, "lon0": -96.0, "lat1": 29.5, "lat2": 45.5}),
    "EPSG:3413": Crs(WGS84, "stere", {"lat0": 90.0, "lon0": -45.0, "lat1": 70.0}), "EPSG:3031": Crs(WGS84, "stere", {"lat0": -90.0, "lon0": 0.0, "lat1": -71.0}),
    "ESRI:54009": Crs(WGS84, "moll"), "EPSG:4087": Crs(WGS84, "eqc"),
}


def crs(name: str) -> Crs:
    """The system of a code, of WKT (either version) or of a PROJ string; others raise."""
    key = (name or "").strip()
    if key.upper() in _KNOWN:
        return _KNOWN[key.upper()]
    if found := re.fullmatch(r"(?i)EPSG:(326|327|258)(\d\d)", key):
        zone = int(found[2])
        if 1 <= zone <= 60:
            south = found[1] == "327"
            return Crs(GRS80 if found[1] == "258" else WGS84, "tmerc", {"lon0": 6.0 * zone - 183, "k": 0.9996, "east": 500_000.0, "north": 10_000_000.0 if south else 0.0})
    if "[" in key:
        return from_wkt(key)
    if key.startswith("+proj"):
        return _from_proj(key)
    if mollweide.is_mollweide_name(key):
        return _KNOWN["ESRI:54009"]
    raise ValueError(f"the CRS {name} is not supported")


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _nodes(text: str) -> list:
    """WKT as nested lists: ``[keyword, value or node, ...]``."""
    root: list = [""]
    stack = [root]
    for quoted, word, opened, closed in re.findall(r'"((?:[^"]|"")*)"|([^\s,\[\]()"]+)|([\[(])|([\])])', text):
        if opened:
            node = [str(stack[-1].pop()).upper()]
            stack[-1].append(node)
            stack.append(node)
        elif closed:
            stack.pop()
        else:
            stack[-1].append(word or quoted)
    return root[1]


def _all(node: list, *names: str) -> list[list]:
    """Nodes of these names at any depth."""
    out = []
    for n in node[1:]:
        if isinstance(n, list):
            out += ([n] if n[0] in names else []) + _all(n, *names)
    return out


def from_wkt(text: str) -> Crs:
    """A geographic or projected system from WKT of version 1 or 2.

    Vertical parts of a compound system are left out.  Axis order is taken as east, north.
    """
    node = _nodes(text)
    if node[0] in ("COMPD_CS", "COMPOUNDCRS", "BOUNDCRS"):
        found = _all(node, "PROJCS", "PROJCRS", "PROJECTEDCRS") or _all(node, "GEOGCS", "GEOGCRS", "GEODCRS", "GEOGRAPHICCRS")
        shift = [float(p[2]) for p in _all(node, "PARAMETER") if "translation" in _plain(p[1]) or "rotation" in _plain(p[1]) or _plain(p[1]) == "scaledifference"] if node[0] == "BOUNDCRS" else []
        node = found[0]
    else:
        shift = []
    spheroid = _all(node, "SPHEROID", "ELLIPSOID")
    if not spheroid:
        raise ValueError("the CRS has no ellipsoid")
    own = [float(v) for t in _all(node, "TOWGS84")[:1] for v in t[1:]] or shift
    prime = _all(node, "PRIMEM", "PRIMEMERIDIAN")
    meridian = float(prime[0][2]) if prime else 0.0
    ellipsoid = (float(spheroid[0][2]), float(spheroid[0][3]))
    if node[0] not in ("PROJCS", "PROJCRS", "PROJECTEDCRS"):
        unit = next((math.degrees(float(u[2])) for u in node[1:] if isinstance(u, list) and u[0] in ("UNIT", "ANGLEUNIT")), 1.0)
        return Crs(ellipsoid, None, {}, tuple(own), 1.0 if abs(unit - 1) < 1e-9 else unit, meridian)
    method = _all(node, "PROJECTION", "METHOD")
    unit = next((float(u[2]) for u in reversed(node) if isinstance(u, list) and u[0] in ("UNIT", "LENGTHUNIT")), None)
    if unit is None:
        lengths = [u for a in node[1:] if isinstance(a, list) and a[0] in ("AXIS", "CS") for u in _all(a, "LENGTHUNIT")]
        unit = float(lengths[0][2]) if lengths else 1.0
    parameters = {}
    for p in _all(node, "PARAMETER"):
        if (key := _PARAMETERS.get(_plain(p[1]))) is None:
            continue
        value, own_unit = float(p[2]), next((float(u[2]) for u in p[3:] if isinstance(u, list) and u[0] in ("ANGLEUNIT", "LENGTHUNIT")), None)
        if key in ("east", "north"):
            value *= unit if own_unit is None else own_unit
        elif key != "k" and own_unit is not None and abs(math.degrees(own_unit) - 1) > 1e-9:
            value *= math.degrees(own_unit)
        parameters[key] = value
    return Crs(ellipsoid, _plain(method[0][1]), parameters, tuple(own), unit, meridian)


def _from_proj(text: str) -> Crs:
    given = dict(re.findall(r"\+(\w+)=(\S+)", text))
    named = {"WGS84": WGS84, "GRS80": GRS80, "intl": INTERNATIONAL, "sphere": (6370997.0, 0.0)}
    if "R" in given:
        ellipsoid = (float(given["R"]), 0.0)
    elif "a" in given:
        a, b = float(given["a"]), float(given.get("b", given["a"]))
        ellipsoid = (a, float(given["rf"]) if "rf" in given else a / (a - b) if a != b else 0.0)
    else:
        ellipsoid = named.get(given.get("ellps", given.get("datum", "WGS84")), WGS84)
    shift = tuple(float(v) for v in given.get("towgs84", "").split(",") if v)
    if given["proj"] in ("longlat", "latlong"):
        return Crs(ellipsoid, None, {}, shift)
    if given["proj"] == "utm":
        south = 10_000_000.0 if "+south" in text else 0.0
        return Crs(ellipsoid, "tmerc", {"lon0": 6.0 * int(given["zone"]) - 183, "k": 0.9996, "east": 500_000.0, "north": south}, shift)
    parameters = {_PARAMETERS[k.replace("_", "")]: float(v) for k, v in given.items() if k.replace("_", "") in _PARAMETERS}
    return Crs(ellipsoid, given["proj"], parameters, shift, float(given.get("to_meter", 1.0)))


def between(source: str, target: str) -> list[Step]:
    """Steps from coordinates of one system to another's; none where both are the same."""
    if source == target:
        return []
    a, b = crs(source), crs(target)
    return [] if a == b else [*a.inverse(), *b.forward()]
