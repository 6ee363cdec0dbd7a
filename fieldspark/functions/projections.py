"""Map projections as column expressions: Web Mercator and every transverse Mercator (UTM, Gauss-Krueger).

The transverse Mercator is Krueger's series in the third flattening n to the sixth order, both ways: below a micrometre within a
zone of six degrees and well beyond. Geographic systems of one datum family (WGS 84, ETRS89, NAD83, CGCS2000) are taken as equal,
which holds within about a metre. Coordinates are always (x, y), that is, longitude first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere of Web Mercator; semi-major axis and inverse flattening of ellipsoids.
EARTH = 6378137.0
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101)}

#: Coefficients of n, n^2, .. n^6 in each term of the series.
ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
DELTA = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175),
    (0, 0, 0, 0, 4174 / 315, -144838 / 6237),
    (0, 0, 0, 0, 0, 601676 / 22275),
)


def terms(table: tuple[tuple[float, ...], ...], n: float) -> list[float]:
    return [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in table]


Pair = tuple[Column, Column]
Step = Callable[[Column, Column], Pair]


@dataclass(frozen=True)
class TransverseMercator:
    """A transverse Mercator projection: central meridian in degrees, scale on it, false easting and northing in metres."""

    central: float
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0
    ellipsoid: str = "WGS84"

    @property
    def third_flattening(self) -> float:
        f = 1 / ELLIPSOIDS[self.ellipsoid][1]
        return f / (2 - f)

    @property
    def radius(self) -> float:
        """Scaled radius of the rectifying sphere."""
        n = self.third_flattening
        return self.scale * ELLIPSOIDS[self.ellipsoid][0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    @property
    def eccentricity(self) -> float:
        n = self.third_flattening
        return 2 * math.sqrt(n) / (1 + n)

    # Both ways are steps of few terms, each a function of two columns, so that a step's values can be bound before the next repeats them.

    def forward(self) -> list[Step]:
        e, alpha = self.eccentricity, list(enumerate(terms(ALPHA, self.third_flattening), 1))

        def conformal(lon: Column, lat: Column) -> Pair:
            sine = F.sin(F.radians(lat))
            return F.radians(lon - self.central), F.sinh(F.atanh(sine) - e * F.atanh(e * sine))

        def sphere(turn: Column, t: Column) -> Pair:
            return F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn))), F.atan2(t, F.cos(turn))

        def plane(east: Column, north: Column) -> Pair:
            x = sum((a * F.cos(2 * j * north) * F.sinh(2 * j * east) for j, a in alpha), east)
            y = sum((a * F.sin(2 * j * north) * F.cosh(2 * j * east) for j, a in alpha), north)
            return self.easting + self.radius * x, self.northing + self.radius * y

        return [conformal, sphere, plane]

    def inverse(self) -> list[Step]:
        beta, delta = (list(enumerate(terms(t, self.third_flattening), 1)) for t in (BETA, DELTA))

        def scaled(x: Column, y: Column) -> Pair:
            return (x - self.easting) / self.radius, (y - self.northing) / self.radius

        def sphere(right: Column, up: Column) -> Pair:
            east = sum((-b * F.cos(2 * j * up) * F.sinh(2 * j * right) for j, b in beta), right)
            north = sum((-b * F.sin(2 * j * up) * F.cosh(2 * j * right) for j, b in beta), up)
            return east, north

        def conformal(east: Column, north: Column) -> Pair:
            return self.central + F.degrees(F.atan2(F.sinh(east), F.cos(north))), F.asin(F.sin(north) / F.cosh(east))

        def geodetic(lon: Column, lat: Column) -> Pair:
            return lon, F.degrees(sum((d * F.sin(2 * j * lat) for j, d in delta), lat))

        return [scaled, sphere, conformal, geodetic]


@dataclass(frozen=True)
class WebMercator:
    def forward(self) -> list[Step]:
        return [lambda lon, lat: (F.radians(lon) * EARTH, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH)]

    def inverse(self) -> list[Step]:
        return [lambda x, y: (F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2))]


@dataclass(frozen=True)
class Geographic:
    def forward(self) -> list[Step]:
        return []

    def inverse(self) -> list[Step]:
        return []


Projection = TransverseMercator | WebMercator | Geographic
#: Codes of geographic systems.
GEOGRAPHIC = (4326, 4258, 4269, 4490)


def _rules() -> dict[int, Projection]:
    """Every known code, by the rules that the codes follow."""
    known: dict[int, Projection] = {code: Geographic() for code in GEOGRAPHIC} | {3857: WebMercator()}
    for zone in range(1, 61):
        known[32600 + zone] = TransverseMercator(6 * zone - 183)
        known[32700 + zone] = TransverseMercator(6 * zone - 183, northing=10_000_000.0)
    known |= {25800 + zone: TransverseMercator(6 * zone - 183, ellipsoid="GRS80") for zone in range(28, 39)}  # ETRS89
    known |= {26900 + zone: TransverseMercator(6 * zone - 183, ellipsoid="GRS80") for zone in range(1, 24)}  # NAD83
    for k in range(11):  # CGCS2000, six degrees: with the zone before the easting, and without
        known[4491 + k] = TransverseMercator(75 + 6 * k, 1.0, (13 + k) * 1e6 + 500_000, ellipsoid="GRS80")
        known[4502 + k] = TransverseMercator(75 + 6 * k, 1.0, ellipsoid="GRS80")
    for k in range(21):  # the same, three degrees
        known[4513 + k] = TransverseMercator(75 + 3 * k, 1.0, (25 + k) * 1e6 + 500_000, ellipsoid="GRS80")
        known[4534 + k] = TransverseMercator(75 + 3 * k, 1.0, ellipsoid="GRS80")
    return known


KNOWN = _rules()


def projection(crs: str | Projection) -> Projection:
    """The projection of "EPSG:<code>"; projections themselves are returned. Codes without a rule raise ValueError."""
    if not isinstance(crs, str):
        return crs
    code = crs.strip().upper().removeprefix("EPSG:")
    if not code.isdecimal() or int(code) not in KNOWN:
        raise ValueError(f"no closed form for {crs}; pass a TransverseMercator for a system of that kind")
    return KNOWN[int(code)]


def _steps(src: str | Projection, dst: str | Projection) -> list[Step]:
    a, b = projection(src), projection(dst)
    return [] if a == b else a.inverse() + b.forward()


def reproject(x: Column, y: Column, src: str | Projection, dst: str | Projection) -> Pair:
    """Coordinates in another system, over longitude and latitude; equal systems change nothing. Nulls stay null."""
    if Geographic() not in (projection(src), projection(dst)) and _steps(src, dst):
        # The terms of one series in each term of another would be thousands: bind what lies between.
        moved = F.get(reproject_vertices(F.array(F.struct(x.alias("x"), y.alias("y"))), src, dst), 0)
        return moved["x"], moved["y"]
    for step in _steps(src, dst):
        x, y = step(x, y)
    return x, y


def reproject_vertices(vertices: Column, src: str | Projection, dst: str | Projection) -> Column:
    """The same for array<struct<x, y>>, one step after the other."""

    def moved(step: Step) -> Callable[[Column], Column]:
        return lambda v: F.struct(*[c.cast("double").alias(n) for c, n in zip(step(v["x"], v["y"]), "xy", strict=True)])

    for step in _steps(src, dst):
        vertices = F.transform(vertices, moved(step))
    return vertices


def zone_of(lon: Column, lat: Column) -> Column:
    """"EPSG:<code>" of the UTM zone of a place, by its hemisphere; without the exceptions of Norway and Svalbard."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))
    return F.concat(F.lit("EPSG:"), (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("string"))
