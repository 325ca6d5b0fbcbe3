"""Coordinate reference systems in closed form.

Geodetic, geocentric and Web Mercator coordinates are column expressions. Lambert conformal conic, transverse Mercator, oblique
stereographic and Swiss oblique Mercator projections and shifts between datums are NumPy formulas behind an Arrow function. A system
that is not known raises: coordinates never pass through unchanged. Others of these kinds can be registered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapoint.errors import MixedCrs

# Ellipsoids (semi-major axis, inverse flattening).
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
INTL24 = (6378388.0, 297.0)
BESSEL = (6377397.155, 299.1528128)
AIRY = (6377563.396, 299.3249646)
# Position vector shifts to WGS84 (metres, arc seconds, parts per million).
AMERSFOORT = (565.2369, 50.0087, 465.658, -0.406857, 0.350733, -1.87035, 4.0812)
OSGB36 = (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
BELGIUM72 = (-106.8686, 52.2978, -103.7239, 0.3366, -0.457, 1.8422, -1.2747)
SWISS = (674.374, 15.056, 405.346, 0.0, 0.0, 0.0, 0.0)
DHDN = (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)
HONG_KONG = (-162.619, -276.959, -161.764, 0.067753, -2.243649, -1.158827, -1.094246)


class UnsupportedCrs(ValueError):
    """No formula for this system is known."""


@dataclass(frozen=True)
class Projection:
    kind: str  # geodetic, geocentric, webmercator, lcc, tm, sterea, somerc
    ellipsoid: tuple[float, float] = WGS84
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    k0: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    shift: tuple[float, ...] | None = None  # to WGS84


# Parameters of the systems by EPSG code. 3942 to 3950 are the French conic zones 42 to 50.
KNOWN = {
    4326: Projection("geodetic"),
    4979: Projection("geodetic"),
    4258: Projection("geodetic", GRS80),
    4269: Projection("geodetic", GRS80),
    4937: Projection("geodetic", GRS80),
    4978: Projection("geocentric"),
    4936: Projection("geocentric", GRS80),
    3857: Projection("webmercator"),
    2056: Projection("somerc", BESSEL, 7.439583333333333, 46.95240555555556, 0, 0, 1.0, 2600000.0, 1200000.0, SWISS),
    21781: Projection("somerc", BESSEL, 7.439583333333333, 46.95240555555556, 0, 0, 1.0, 600000.0, 200000.0, SWISS),
    2154: Projection("lcc", GRS80, 3.0, 46.5, 44.0, 49.0, 1.0, 700000.0, 6600000.0),
    2157: Projection("tm", GRS80, -8.0, 53.5, 0, 0, 0.99982, 600000.0, 750000.0),
    2180: Projection("tm", GRS80, 19.0, 0.0, 0, 0, 0.9993, 500000.0, -5300000.0),
    2193: Projection("tm", GRS80, 173.0, 0.0, 0, 0, 0.9996, 1600000.0, 10000000.0),
    2326: Projection("tm", INTL24, 114.178555556, 22.312133333, 0, 0, 1.0, 836694.05, 819069.8, HONG_KONG),
    3059: Projection("tm", GRS80, 24.0, 0.0, 0, 0, 0.9996, 500000.0, -6000000.0),
    3067: Projection("tm", GRS80, 27.0, 0.0, 0, 0, 0.9996, 500000.0, 0.0),
    3301: Projection("lcc", GRS80, 24.0, 57.51755393055556, 59.33333333333334, 58.0, 1.0, 500000.0, 6375000.0),
    3812: Projection("lcc", GRS80, 4.359215833333333, 50.797815, 49.83333333333334, 51.16666666666666, 1.0, 649328.0, 665262.0),
    27700: Projection("tm", AIRY, -2.0, 49.0, 0, 0, 0.9996012717, 400000.0, -100000.0, OSGB36),
    28992: Projection("sterea", BESSEL, 5.387638888888889, 52.15616055555555, 0, 0, 0.9999079, 155000.0, 463000.0, AMERSFOORT),
    31370: Projection("lcc", INTL24, 4.367486666666666, 90.0, 51.16666723333333, 49.8333339, 1.0, 150000.013, 5400088.438, BELGIUM72),
} | {  # conic zones 42 to 50 of France
    3900 + z: Projection("lcc", GRS80, 3.0, float(z), z - 0.75, z + 0.75, 1.0, 1700000.0, (z - 41) * 1e6 + 200000.0) for z in range(42, 51)
} | {  # zones of six degrees, north and south
    base + z: Projection("tm", WGS84, 6.0 * z - 183, 0.0, 0, 0, 0.9996, 500000.0, north) for base, north in ((32600, 0.0), (32700, 1e7)) for z in range(1, 61)
} | {  # the same of Europe, North America and Australia
    base + z: Projection("tm", GRS80, 6.0 * z - 183, 0.0, 0, 0, 0.9996, 500000.0, north)
    for base, zones, north in ((25800, range(28, 39), 0.0), (26900, range(1, 24), 0.0), (28300, range(48, 59), 1e7), (7800, range(46, 60), 1e7)) for z in zones
} | {  # zones of three degrees of Germany
    31464 + z: Projection("tm", BESSEL, 3.0 * z, 0.0, 0, 0, 1.0, z * 1e6 + 500000.0, 0.0, DHDN) for z in range(2, 6)
}


def register(code: int, projection: Projection) -> None:
    """A further system, or other parameters for a known one."""
    KNOWN[code] = projection


def code_of(crs: int | str) -> int:
    return int(str(crs).upper().removeprefix("EPSG:"))


def known(code: int | str) -> Projection:
    number = code_of(code)
    if number not in KNOWN:
        raise UnsupportedCrs(f"EPSG:{number}")
    return KNOWN[number]


def _e2(p: Projection) -> float:
    f = 1 / p.ellipsoid[1]
    return f * (2 - f)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to Web Mercator metres."""
    r = WGS84[0]
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = WGS84[0]
    return F.degrees(x / r), F.degrees(F.atan(F.exp(y / r)) * 2 - math.pi / 2)


def geocentric(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres above the WGS84 ellipsoid to earth-centred metres."""
    a, f = WGS84[0], 1 / WGS84[1]
    e2 = f * (2 - f)
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = a / F.sqrt(1 - e2 * s * s)
    return (n + height) * c * F.cos(F.radians(lon)), (n + height) * c * F.sin(F.radians(lon)), (n * (1 - e2) + height) * s


def _conic(p: Projection) -> tuple[float, float, float, float]:
    e = math.sqrt(_e2(p))

    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def t(lat: float) -> float:
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    a, b, c = (math.radians(v) for v in (p.lat1, p.lat2, p.lat0))
    n = math.log(m(a) / m(b)) / math.log(t(a) / t(b)) if a != b else math.sin(a)
    big_f = m(a) / (n * t(a) ** n)
    return e, n, big_f, p.ellipsoid[0] * big_f * t(c) ** n


def to_geodetic(p: Projection, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitude, latitude in degrees, height."""
    a, e2 = p.ellipsoid[0], _e2(p)
    if p.kind == "geodetic":
        return x, y, z
    if p.kind == "webmercator":
        return np.degrees(x / a), np.degrees(2 * np.arctan(np.exp(y / a)) - math.pi / 2), z
    if p.kind == "geocentric":
        r = np.hypot(x, y)
        lat = np.arctan2(z, r * (1 - e2))
        for _ in range(8):
            n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
            lat = np.arctan2(z + e2 * n * np.sin(lat), r)
        n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        return np.degrees(np.arctan2(y, x)), np.degrees(lat), r * np.cos(lat) + z * np.sin(lat) - a * a / n
    if p.kind == "lcc":
        e, n, big_f, rho0 = _conic(p)
        dx, dy = x - p.x0, rho0 - (y - p.y0)
        rho = np.sign(n) * np.hypot(dx, dy)
        t = (rho / (a * big_f)) ** (1 / n)
        lat = math.pi / 2 - 2 * np.arctan(t)
        for _ in range(10):
            s = e * np.sin(lat)
            lat = math.pi / 2 - 2 * np.arctan(t * ((1 - s) / (1 + s)) ** (e / 2))
        return np.degrees(np.arctan2(dx, dy) / n) + p.lon0, np.degrees(lat), z
    if p.kind == "sterea":
        r, n, c, chi0 = _sphere(p)
        e, dx, dy = math.sqrt(e2), x - p.x0, y - p.y0
        near, far = 2 * r * p.k0 * math.tan(math.pi / 4 - chi0 / 2), 4 * r * p.k0 * math.tan(chi0)
        i = np.arctan2(dx, far + near + dy)
        j = np.arctan2(dx, near - dy) - i
        chi = chi0 + 2 * np.arctan((dy - dx * np.tan(j / 2)) / (2 * r * p.k0))
        psi = 0.5 * np.log((1 + np.sin(chi)) / (c * (1 - np.sin(chi)))) / n
        return np.degrees((j + 2 * i) / n) + p.lon0, np.degrees(_latitude(psi, e)), z
    if p.kind == "somerc":
        r, alpha, b0, k = _swiss(p)
        turned, b = (x - p.x0) / r, 2 * (np.arctan(np.exp((y - p.y0) / r)) - math.pi / 4)
        lat = np.arcsin(math.cos(b0) * np.sin(b) + math.sin(b0) * np.cos(b) * np.cos(turned))
        lon = np.arctan2(np.sin(turned), math.cos(b0) * np.cos(turned) - math.sin(b0) * np.tan(b))
        return np.degrees(lon / alpha) + p.lon0, np.degrees(_latitude((np.log(np.tan(math.pi / 4 + lat / 2)) - k) / alpha, math.sqrt(e2))), z
    m = _meridian(p, np.radians(p.lat0)) + (y - p.y0) / p.k0
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = m / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    fp = mu + (1.5 * e1 - 27 / 32 * e1**3) * np.sin(2 * mu) + (21 / 16 * e1**2 - 55 / 32 * e1**4) * np.sin(4 * mu) + 151 / 96 * e1**3 * np.sin(6 * mu) + 1097 / 512 * e1**4 * np.sin(8 * mu)
    ep2, s, c = e2 / (1 - e2), np.sin(fp), np.cos(fp)
    c1, t1, n1 = ep2 * c**2, np.tan(fp) ** 2, a / np.sqrt(1 - e2 * s**2)
    r1, d = a * (1 - e2) / (1 - e2 * s**2) ** 1.5, (x - p.x0) / (n1 * p.k0)
    lat = fp - n1 * np.tan(fp) / r1 * (d**2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1**2 - 252 * ep2 - 3 * c1**2) * d**6 / 720)
    lon = (d - (1 + 2 * t1 + c1) * d**3 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1**2 + 8 * ep2 + 24 * t1**2) * d**5 / 120) / c
    return np.degrees(lon) + p.lon0, np.degrees(lat), z


def _isometric(lat: np.ndarray | float, e: float) -> np.ndarray:
    s = e * np.sin(lat)
    return np.log(np.tan(math.pi / 4 + lat / 2) * ((1 - s) / (1 + s)) ** (e / 2))


def _latitude(psi: np.ndarray, e: float) -> np.ndarray:
    """The latitude of an isometric one."""
    lat = 2 * np.arctan(np.exp(psi)) - math.pi / 2
    for _ in range(8):
        lat = 2 * np.arctan(np.exp(psi + e * np.arctanh(e * np.sin(lat)))) - math.pi / 2
    return lat


def _sphere(p: Projection) -> tuple[float, float, float, float]:
    """The conformal sphere of an oblique stereographic projection: radius, n, c and the latitude of the origin on it."""
    a, e2 = p.ellipsoid[0], _e2(p)
    s, e = math.sin(math.radians(p.lat0)), math.sqrt(e2)
    r = a * math.sqrt(1 - e2) / (1 - e2 * s * s)
    n = math.sqrt(1 + e2 * (1 - s * s) ** 2 / (1 - e2))
    w = ((1 + s) / (1 - s) * ((1 - e * s) / (1 + e * s)) ** e) ** n
    sine = (w - 1) / (w + 1)
    c = (n + s) * (1 - sine) / ((n - s) * (1 + sine))
    return r, n, c, math.asin((c * w - 1) / (c * w + 1))


def _swiss(p: Projection) -> tuple[float, float, float, float]:
    """Radius, ratio of longitudes, latitude of the origin and constant of the sphere of the oblique Mercator projection."""
    a, e2, lat = p.ellipsoid[0], _e2(p), math.radians(p.lat0)
    alpha = math.sqrt(1 + e2 / (1 - e2) * math.cos(lat) ** 4)
    b0 = math.asin(math.sin(lat) / alpha)
    k = math.log(math.tan(math.pi / 4 + b0 / 2)) - alpha * float(_isometric(lat, math.sqrt(e2)))
    return p.k0 * a * math.sqrt(1 - e2) / (1 - e2 * math.sin(lat) ** 2), alpha, b0, k


def _meridian(p: Projection, lat: np.ndarray | float) -> np.ndarray | float:
    e2 = _e2(p)
    return p.ellipsoid[0] * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * np.sin(2 * lat)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * np.sin(4 * lat) - 35 * e2**3 / 3072 * np.sin(6 * lat)
    )


def from_geodetic(p: Projection, lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, e2 = p.ellipsoid[0], _e2(p)
    lo, la = np.radians(lon), np.radians(lat)
    if p.kind == "geodetic":
        return lon, lat, h
    if p.kind == "webmercator":
        return lo * a, np.log(np.tan(math.pi / 4 + la / 2)) * a, h
    if p.kind == "geocentric":
        n = a / np.sqrt(1 - e2 * np.sin(la) ** 2)
        return (n + h) * np.cos(la) * np.cos(lo), (n + h) * np.cos(la) * np.sin(lo), (n * (1 - e2) + h) * np.sin(la)
    if p.kind == "lcc":
        e, n, big_f, rho0 = _conic(p)
        s = e * np.sin(la)
        rho = a * big_f * (np.tan(math.pi / 4 - la / 2) / ((1 - s) / (1 + s)) ** (e / 2)) ** n
        angle = n * np.radians(lon - p.lon0)
        return p.x0 + rho * np.sin(angle), p.y0 + rho0 - rho * np.cos(angle), h
    if p.kind == "sterea":
        r, n, c, chi0 = _sphere(p)
        w = c * np.exp(2 * n * _isometric(la, math.sqrt(e2)))
        chi, angle = np.arcsin((w - 1) / (w + 1)), n * np.radians(lon - p.lon0)
        b = 1 + np.sin(chi) * math.sin(chi0) + np.cos(chi) * math.cos(chi0) * np.cos(angle)
        reach = 2 * r * p.k0 / b
        return p.x0 + reach * np.cos(chi) * np.sin(angle), p.y0 + reach * (np.sin(chi) * math.cos(chi0) - np.cos(chi) * math.sin(chi0) * np.cos(angle)), h
    if p.kind == "somerc":
        r, alpha, b0, k = _swiss(p)
        b = 2 * (np.arctan(np.exp(alpha * _isometric(la, math.sqrt(e2)) + k)) - math.pi / 4)
        angle = alpha * np.radians(lon - p.lon0)
        turned = np.arctan2(np.sin(angle), math.sin(b0) * np.tan(b) + math.cos(b0) * np.cos(angle))
        lifted = np.arcsin(math.cos(b0) * np.sin(b) - math.sin(b0) * np.cos(b) * np.cos(angle))
        return p.x0 + r * turned, p.y0 + r / 2 * np.log((1 + np.sin(lifted)) / (1 - np.sin(lifted))), h
    ep2, s, c = e2 / (1 - e2), np.sin(la), np.cos(la)
    n, t, cc = a / np.sqrt(1 - e2 * s**2), np.tan(la) ** 2, ep2 * c**2
    aa = np.radians(lon - p.lon0) * c
    m = _meridian(p, la) - _meridian(p, math.radians(p.lat0))
    x = p.k0 * n * (aa + (1 - t + cc) * aa**3 / 6 + (5 - 18 * t + t**2 + 72 * cc - 58 * ep2) * aa**5 / 120)
    y = p.k0 * (m + n * np.tan(la) * (aa**2 / 2 + (5 - t + 9 * cc + 4 * cc**2) * aa**4 / 24 + (61 - 58 * t + t**2 + 600 * cc - 330 * ep2) * aa**6 / 720))
    return p.x0 + x, p.y0 + y, h


def _shifted(lon: np.ndarray, lat: np.ndarray, h: np.ndarray, ellipsoid: tuple[float, float], shift: tuple[float, ...], to_wgs84: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Geodetic coordinates moved between an older datum and WGS84 by seven parameters; heights stay as they are."""
    tx, ty, tz, rx, ry, rz, ppm = shift
    ax, ay, az = (math.radians(v / 3600) for v in (rx, ry, rz))
    turn = (1 + ppm * 1e-6) * np.array([[1, -az, ay], [az, 1, -ax], [-ay, ax, 1]])
    own, world = Projection("geocentric", ellipsoid), Projection("geocentric", WGS84)
    p = np.stack(from_geodetic(own if to_wgs84 else world, lon, lat, np.zeros_like(lon)))
    move = np.array([[tx], [ty], [tz]])
    p = turn @ p + move if to_wgs84 else np.linalg.solve(turn, p - move)
    lon, lat, _ = to_geodetic(world if to_wgs84 else own, *p)
    return lon, lat, h


def _between(a: Projection, b: Projection, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = to_geodetic(a, x, y, z)
    if (a.shift, a.shift and a.ellipsoid) != (b.shift, b.shift and b.ellipsoid):
        if a.shift:
            p = _shifted(*p, a.ellipsoid, a.shift, True)
        if b.shift:
            p = _shifted(*p, b.ellipsoid, b.shift, False)
    return from_geodetic(b, *p)


def transform(source: int | str, target: int | str, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates in x, y order. Datums without a shift (WGS84 and those fixed to it within a metre) are taken as equal."""
    a, b = known(source), known(target)
    return (x, y, z) if a == b else _between(a, b, x, y, z)


def reproject(points: DataFrame, source: int | str | None, target: int | str | None, swap_axes: bool = False) -> DataFrame:
    """points with x, y, z moved from one system to another; unchanged (and planned as nothing) without a target or if equal.

    ``swap_axes``: the source's first axis is its northing. A target without a source raises ValueError.
    """
    if target is None or (source is not None and (code_of(source) == code_of(target) or known(source) == known(target))):
        return points
    if source is None:
        raise ValueError("a target system needs a source system")
    a, b = known(source), known(target)
    x, y, z = (F.col("y"), F.col("x"), F.col("z")) if swap_axes else (F.col("x"), F.col("y"), F.col("z"))
    plain = {a.kind, b.kind} <= {"geodetic", "webmercator", "geocentric"} and not a.shift and not b.shift
    if plain and a.kind != "geocentric" and (b.kind != "geocentric" or b.ellipsoid == WGS84):
        lon, lat = (x, y) if a.kind == "geodetic" else unmercator(x, y)
        out = {"geodetic": (lon, lat, z), "webmercator": (*mercator(lon, lat), z), "geocentric": geocentric(lon, lat, z)}[b.kind]
        return points.withColumns(dict(zip("xyz", out, strict=True)))

    @F.pandas_udf("struct<x:double,y:double,z:double>")
    def move(xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("xyz", _between(a, b, xs.to_numpy(float), ys.to_numpy(float), zs.to_numpy(float)), strict=True)))

    moved = points.withColumn("_moved", move(x.cast("double"), y.cast("double"), z.cast("double")))
    return moved.withColumns({v: F.col(f"_moved.{v}") for v in "xyz"}).drop("_moved")


def in_use(files: DataFrame, file: str, crs: str) -> DataFrame:
    """crs, files: the reference systems that files name, and how many files each. Files without one are left out."""
    named = files.where(F.col(crs).isNotNull() & F.col(file).isNotNull()).select(F.col(crs).alias("crs"), file).distinct()
    return named.groupBy("crs").agg(F.count(F.lit(1)).alias("files"))


def the_one(files: DataFrame, file: str, crs: str) -> str | None:
    """The reference system of all files that name one; None if none does, MixedCrs if they differ."""
    found = in_use(files, file, crs).orderBy("crs").limit(3).collect()  # three are enough to tell
    if len(found) > 1:
        raise MixedCrs("files of several reference systems: " + ", ".join(f"{r.crs} ({r.files} files)" for r in found))
    return found[0].crs if found else None
