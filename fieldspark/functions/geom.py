"""Geometry as column expressions. Polygons are arrays of struct<x, y>; an affine (a, b, c, d, e, f) maps
column and row of a pixel to x = c + a*col + b*row, y = f + d*col + e*row. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .projections import EARTH as EARTH
from .projections import GEOGRAPHIC, KNOWN, Projection, reproject_vertices
from .projections import reproject as reproject

AFFINE = tuple("abcdef")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _affine(t: tuple[Column, ...] | None) -> tuple[Column, ...]:
    return t or tuple(F.col(n) for n in AFFINE)


def pixel_to_geo(col: Column, row: Column, t: tuple[Column, ...] | None = None) -> tuple[Column, Column]:
    a, b, c, d, e, f = _affine(t)
    return c + a * col + b * row, f + d * col + e * row


def geo_to_pixel(x: Column, y: Column, t: tuple[Column, ...] | None = None) -> tuple[Column, Column]:
    """Inverse affine; null where it has no inverse."""
    a, b, c, d, e, f = _affine(t)
    det = F.nullif(a * e - b * d, F.lit(0.0))
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def polygon_pixel_to_geo(polygon: Column, t: tuple[Column, ...] | None = None) -> Column:
    return F.transform(polygon, lambda v: point(*pixel_to_geo(v["x"], v["y"], t)))


def boxes_pixel_to_geo(x0: Column, y0: Column, x1: Column, y1: Column, t: tuple[Column, ...] | None = None) -> tuple[Column, ...]:
    """Two mapped corners, put in order."""
    (ax, ay), (bx, by) = pixel_to_geo(x0, y0, t), pixel_to_geo(x1, y1, t)
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


def pixel_square_from_geo(x: Column, y: Column, size: Column, t: tuple[Column, ...] | None = None) -> tuple[Column, ...]:
    """Geo bounds of a square of so many pixels around a geo centre."""
    col, row = geo_to_pixel(x, y, t)
    half = size / 2
    return boxes_pixel_to_geo(col - half, row - half, col + half, row + half, t)


def square_around(x: Column, y: Column, size: Column) -> tuple[Column, ...]:
    half = size / 2
    return x - half, y - half, x + half, y + half


def clamp_size(size: Column, least: int = 128, most: int = 2048) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), size))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed ring of five vertices, from the least corner along x."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def close_ring(ring: Column) -> Column:
    return F.when((F.size(ring) > 0) & (F.get(ring, 0) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def box_center(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    return (x0 + x1) * 0.5, (y0 + y1) * 0.5


def window_polygon(x0: Column, y0: Column, x1: Column, y1: Column, t: tuple[Column, ...] | None = None) -> Column:
    """Top left, top right, bottom right, bottom left of a pixel window, in geo coordinates."""
    return F.array(*[point(*pixel_to_geo(x, y, t)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def polygon_box(polygon: Column) -> tuple[Column, ...]:
    xs, ys = F.transform(polygon, lambda v: v["x"]), F.transform(polygon, lambda v: v["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def unit_vector(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Null where the length is 1e-12 or less."""
    norm = F.sqrt(dx * dx + dy * dy)
    ok = norm > 1e-12
    return F.when(ok, dx / norm), F.when(ok, dy / norm)


def angle_to_y(dx: Column, dy: Column) -> Column:
    """Degrees to turn so that the vector points along +Y."""
    return -F.degrees(F.atan2(dx, dy))


def edge_angle(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def project(x: Column, y: Column, ox: Column, oy: Column, ux: Column, uy: Column) -> tuple[Column, Column]:
    """(along, perpendicular): dot products of the point from its origin with (ux, uy) and (-uy, ux)."""
    dx, dy = x - ox, y - oy
    return dx * ux + dy * uy, dy * ux - dx * uy


def metres_to_bins(distance: Column, width: Column) -> Column:
    return F.when((distance <= 0) | (width <= 0), F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.ceil(distance / width)))


def _overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    return w * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def _area(a: tuple[Column, ...]) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); the union is at least 1e-9."""
    both = _overlap(a, b)
    return both / F.greatest(_area(a) + _area(b) - both, F.lit(1e-9))


def ios(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over the smaller area, which is at least 1e-9."""
    return _overlap(a, b) / F.greatest(F.least(_area(a), _area(b)), F.lit(1e-9))


def edge_flags(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return F.struct((x0 == 0).alias("left"), (y0 == 0).alias("top"), (x1 >= width).alias("right"), (y1 >= height).alias("bottom"))


def inside_border(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, edge: Column, border: float = 2.0) -> Column:
    """Not near a border of the slice, sides at the raster's own edge apart; true where there are no pixel boxes."""
    sides = (edge["left"] | (x0 > border)) & (edge["top"] | (y0 > border)) & (edge["right"] | (x1 < w - border)) & (edge["bottom"] | (y1 < h - border))
    return F.coalesce(sides, F.lit(True))


def first_part(parts: Column) -> Column:
    """First part of a multipolygon; null if it has none."""
    return F.get(parts, 0)


def reproject_polygon(polygon: Column, src: str | Projection, dst: str | Projection) -> Column:
    return reproject_vertices(polygon, src, dst)


def axis_unit(unit_name: Column) -> Column:
    """Label of a system's axis unit."""
    name = F.lower(unit_name)
    return F.when(unit_name.isNull(), "unit").when(name.isin("metre", "meter"), "m").when(name == "degree", "deg").otherwise(unit_name)


def unit_of_crs(crs: Column) -> Column:
    """Label of the axis unit of a system, by its code; systems that are not known have "unit"."""
    degrees = [f"EPSG:{code}" for code in GEOGRAPHIC]
    metres = [f"EPSG:{code}" for code in KNOWN if code not in GEOGRAPHIC]
    code = F.upper(crs)
    return axis_unit(F.when(code.isin(degrees), "degree").when(code.isin(metres), "metre"))
