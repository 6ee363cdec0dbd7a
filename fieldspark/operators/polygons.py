"""Points in boundaries, minimum rotated rectangles, and subplot grids on their axes.

boundaries: by.., part_id, rings array<array<struct<x, y>>>. A part's rings count by parity (holes).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoint import Scratch
from ..functions import geom
from ..functions import predicates as pr
from . import grids

BY = ["field_id"]
RECTANGLE = "ox double, oy double, ux double, uy double, vx double, vy double, width double, height double"


def effective_mask(points: DataFrame, boundaries: DataFrame, by: list[str] | None = None, key: str = "fid") -> DataFrame:
    """points with effective: in or on some part of its key's boundaries; true for keys without a boundary.

    A point meets the parts around it, and of those the edges in its own slab. The index is written to the shared folder.
    """
    by = by or BY
    index = grids.boundary_index(boundaries, by, Scratch(points.sparkSession))
    covered = grids.covered_points(points, index, [key]).select(*by, key).distinct().withColumn("covered", F.lit(True))
    have = boundaries.select(*by).distinct().withColumn("bounded", F.lit(True))
    rows = points.join(have, by, "left").join(covered, [*by, key], "left")
    return rows.withColumn("effective", F.col("covered").isNotNull() | F.col("bounded").isNull()).drop("covered", "bounded")


def _bounds(vertices: Column) -> tuple[Column, ...]:
    return geom.polygon_box(vertices)


def keep_cells(cells: DataFrame, boundaries: DataFrame, mode: str = "inside", ring: str = "ring", by: list[str] | None = None) -> DataFrame:
    """Cells whose ring lies within ("inside") or intersects ("touch") a boundary of its key; all of them for "all".

    Predicates are closed. Boundaries with fewer than three vertices, and keys without one, keep all their cells.
    """
    if mode == "all":
        return cells
    if mode not in ("inside", "touch"):
        raise ValueError(f"mode may not be {mode}")
    by = by or BY
    scratch, work = Scratch(cells.sparkSession), Scratch(cells.sparkSession)
    nr, box = "_cell", ("_x0", "_y0", "_x1", "_y1")
    try:
        index = grids.boundary_index(boundaries, by, work)
        rows = scratch.written(cells.withColumn(nr, F.monotonically_increasing_id()), "cells")
        rings = rows.select(*by, nr, F.col(ring).alias("_ring"), *[c.alias(n) for c, n in zip(_bounds(F.col(ring)), box, strict=True)])
        near = grids.box_pairs(rings, index.edges, by, box, grids.EDGE)
        near = near.select(*by, nr, "part", "e", "_ring", pr.edges(F.col("_ring")).alias("_sides"))
        corners = rings.select(*by, nr, F.posexplode("_ring").alias("at", "v")).select(*by, nr, "at", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
        hit = _touching(near, corners, index, nr) if mode == "touch" else _inside(work.written(near, "near"), corners, index, nr)
        free = rows.join(index.parts.select(*by).distinct(), by, "left_anti").select(nr)
        kept = scratch.written(hit.select(nr).union(free).distinct(), "kept")
    finally:
        work.drop()
    return rows.join(kept, nr, "left_semi").drop(nr)


def _touching(near: DataFrame, corners: DataFrame, index: grids.Boundary, nr: str) -> DataFrame:
    """Cells that touch a near edge, hold its end, or have their first corner in a part."""
    e = F.col("e")
    meet = F.exists("_sides", lambda s: pr.touch(s, e)) | pr.covers(F.col("_sides"), e["p"]["x"], e["p"]["y"])
    return near.where(meet).select(nr).union(grids.covered_points(corners.where("at = 0"), index, [nr]).select(nr))


def _inside(near: DataFrame, corners: DataFrame, index: grids.Boundary, nr: str) -> DataFrame:
    """Cells whose corners are in one part, with no edge of that part through them and no stretch of a side outside.

    Where corners of the part touch a side they cut it in stretches, and the middle of each must be in the part. A cell that no edge is near is wholly
    in or out.
    """
    by, e = index.by, F.col("e")
    count = corners.groupBy(*by, nr).agg(F.count("*").alias("n"))
    good = grids.covered_points(corners, index, [nr, "at"]).groupBy(*by, nr, "part").agg(F.count("*").alias("c"))
    good = good.join(count, [*by, nr]).where("c = n").select(*by, nr, "part")
    mid = lambda c: (e["p"][c] + e["q"][c]) / 2
    through = F.exists("_sides", lambda s: pr.cross_properly(s, e)) | pr.inside(F.col("_sides"), e["p"]["x"], e["p"]["y"]) | pr.inside(F.col("_sides"), mid("x"), mid("y"))
    good = good.join(near.where(through).select(*by, nr, "part").distinct(), [*by, nr, "part"], "left_anti")
    sides = near.join(good, [*by, nr, "part"], "left_semi").select(*by, nr, "part", "e", F.posexplode("_sides").alias("side", "s"))
    s = F.col("s")
    dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
    at = ((e["p"]["x"] - s["p"]["x"]) * dx + (e["p"]["y"] - s["p"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.collect_set(F.when(pr.on_edge(e["p"]["x"], e["p"]["y"], s), at))))
    sides = sides.groupBy(*by, nr, "part", "side").agg(F.first("s").alias("s"), cuts.alias("t"))
    middles = F.filter(F.zip_with("t", F.slice("t", 2, F.size("t")), lambda a, b: (a + b) / 2), lambda m: m.isNotNull())
    sides = sides.select(*by, nr, "part", "side", "s", F.posexplode(middles).alias("nth", "m"))
    asked = sides.select(*by, nr, "part", "side", "nth", (s["p"]["x"] + F.col("m") * dx).alias("x"), (s["p"]["y"] + F.col("m") * dy).alias("y"))
    outside = asked.join(grids.covered_points(asked, index, [nr, "side", "nth"], "part"), [*by, nr, "part", "side", "nth"], "left_anti")
    return good.join(outside.select(*by, nr, "part").distinct(), [*by, nr, "part"], "left_anti")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the hull, counter-clockwise from the least; collinear points are left out."""
    rows = np.unique(points, axis=0)
    if len(rows) <= 2:
        return rows

    def half(side: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in side:
            while len(out) >= 2:
                a, b = out[-1] - out[-2], p - out[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(p)
        return out

    low, high = half(rows), half(rows[::-1])
    return np.array(low[:-1] + high[:-1])


def rectangle(points: np.ndarray) -> tuple[float, ...] | None:
    """Minimum-area rotated rectangle: origin, unit long edge u (ux > 0, or ux = 0 and uy > 0), v = u turned by +90 degrees, lengths.

    On equal sides the angle of u is the least in [0, 90) degrees; of equal areas the first least angle counts. None for
    fewer than three points that are not on a line.
    """
    hull = convex_hull(points)
    if len(hull) < 3:
        return None
    edge = np.roll(hull, -1, axis=0) - hull
    angle = np.unique(np.round(np.mod(np.arctan2(edge[:, 1], edge[:, 0]), np.pi / 2), 12))
    c, s = np.cos(angle), np.sin(angle)
    along = hull @ np.array([c, s])
    across = hull @ np.array([-s, c])
    w, h = np.ptp(along, axis=0), np.ptp(across, axis=0)
    area = w * h
    k = int(np.flatnonzero(area <= area.min() * (1 + 1e-9))[0])
    u, width, height = np.array([c[k], s[k]]), w[k], h[k]
    if height > width * (1 + 1e-9):
        u, width, height = np.array([s[k], -c[k]]), height, width
    if u[0] < -1e-12 or (abs(u[0]) <= 1e-12 and u[1] < 0):
        u = -u
    v = np.array([-u[1], u[0]])
    origin = u * (hull @ u).min() + v * (hull @ v).min()
    return (*origin, *u, *v, float(width), float(height))


def rotated_rectangles(vertices: DataFrame, by: list[str] | None = None, salts: int = 32) -> DataFrame:
    """(by.., ox, oy, ux, uy, vx, vy, width, height) of all vertices (by.., x, y) of a key.

    Two phases: hulls of a key's salted shares, then the hull of those hulls, so no task holds a key's points; a share of a
    very large key is again only read in batches. Keys on a line give no row.
    """
    by = by or BY
    kinds = {f.name: f.dataType for f in vertices.schema}
    keys = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in by)

    def shares(batches):
        for rows in batches:
            for key, part in rows.groupby(by, dropna=False, sort=False):
                hull = convex_hull(part[["x", "y"]].to_numpy(float))
                out = pd.DataFrame(hull, columns=["x", "y"])
                for name, value in zip(by, key, strict=True):
                    out[name] = value
                yield out[[*by, "x", "y"]]

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        found = rectangle(rows[["x", "y"]].to_numpy(float))
        names = [c.split()[0] for c in RECTANGLE.split(", ")]
        out = pd.DataFrame([found] if found else [], columns=names, dtype=float)
        for at, name in enumerate(by):
            out.insert(at, name, rows[name].iloc[0] if found else pd.Series(dtype=rows[name].dtype))
        return out

    rows = vertices.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    schema = f"{keys}, x double, y double"
    hulls = rows.mapInPandas(shares, schema)
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(salts))

    def again(part: pd.DataFrame) -> pd.DataFrame:
        hull = pd.DataFrame(convex_hull(part[["x", "y"]].to_numpy(float)), columns=["x", "y"])
        for at, name in enumerate(by):
            hull.insert(at, name, part[name].iloc[0])
        return hull

    hulls = hulls.withColumn("_salt", salt).groupBy(*by, "_salt").applyInPandas(lambda p: again(p.drop(columns="_salt")), schema)
    return hulls.groupBy(*by).applyInPandas(whole, f"{keys}, {RECTANGLE}")


def vertices_of(boundaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., part_id, ring, at, x, y): every vertex as a row."""
    by = by or BY
    rings = boundaries.select(*by, "part_id", F.posexplode("rings").alias("ring", "vertices"))
    return rings.select(*by, "part_id", "ring", F.posexplode("vertices").alias("at", "v")).select(*by, "part_id", "ring", "at", "v.x", "v.y")


def boundary_axes(boundaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., xx, xy, yx, yy): unit long edge and the next edge of the rectangle around all parts."""
    by = by or BY
    r = rotated_rectangles(vertices_of(boundaries, by), by)
    return r.select(*by, F.col("ux").alias("xx"), F.col("uy").alias("xy"), F.col("vx").alias("yx"), F.col("vy").alias("yy"))


def resolve_direction(requests: DataFrame, axes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., ux, uy) from requests (by.., source, px0, py0, px1, py1): boundary_x, boundary_y, their negatives, or manual_draw.

    A key without axes or with a vector of no length gives null.
    """
    by = by or BY
    rows = requests.join(axes, by, "left")
    sign = F.when(F.col("source").contains("-"), -1.0).otherwise(1.0)
    on_x, manual = F.col("source").isin("boundary_x", "boundary_-x"), F.col("source") == "manual_draw"
    known = F.col("source").isin("boundary_x", "boundary_-x", "boundary_y", "boundary_-y")
    dx = F.when(manual, F.col("px1") - F.col("px0")).when(on_x, sign * F.col("xx")).when(known, sign * F.col("yx"))
    dy = F.when(manual, F.col("py1") - F.col("py0")).when(on_x, sign * F.col("xy")).when(known, sign * F.col("yy"))
    ux, uy = geom.unit_vector(dx, dy)
    return rows.select(*by, ux.alias("ux"), uy.alias("uy"))


def direction_segments(points: DataFrame, directions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., x0, y0, x1, y1): the line through the centre of the points' rectangle along the direction, cut by the rectangle."""
    by = by or BY
    r = rotated_rectangles(points.select(*by, "x", "y"), by).join(directions.select(*by, F.col("ux").alias("dx"), F.col("uy").alias("dy")), by)
    cx = F.col("ox") + (F.col("ux") * F.col("width") + F.col("vx") * F.col("height")) / 2
    cy = F.col("oy") + (F.col("uy") * F.col("width") + F.col("vy") * F.col("height")) / 2
    du, dv = F.abs(F.col("dx") * F.col("ux") + F.col("dy") * F.col("uy")), F.abs(F.col("dx") * F.col("vx") + F.col("dy") * F.col("vy"))
    reach = F.least(F.when(du > 1e-12, F.col("width") / 2 / du), F.when(dv > 1e-12, F.col("height") / 2 / dv))
    return r.select(*by, (cx - reach * F.col("dx")).alias("x0"), (cy - reach * F.col("dy")).alias("y0"), (cx + reach * F.col("dx")).alias("x1"), (cy + reach * F.col("dy")).alias("y1"))


def optimal_rotation(boundaries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., angle): degrees of the rectangle's long edge."""
    by = by or BY
    return rotated_rectangles(vertices_of(boundaries, by), by).select(*by, geom.edge_angle(F.col("ux"), F.col("uy")).alias("angle"))


def subplots(
    boundaries: DataFrame,
    rows: int = 5,
    cols: int = 5,
    width: float | None = None,
    height: float | None = None,
    x_spacing: float = 0.0,
    y_spacing: float = 0.0,
    keep: str = "all",
    by: list[str] | None = None,
) -> DataFrame:
    """(by.., id, row, col, ring): a grid on the boundary's rectangle, numbered 1.. row by row after the keep rule.

    Without width and height the cells share the rectangle; with them as many cells as fit are made. Keys with cells of
    no size, or for which none fits, give no row.
    """
    by = by or BY
    r = rotated_rectangles(vertices_of(boundaries, by), by)
    n_c = F.lit(cols) if width is None else F.floor(F.try_divide(F.col("width") + x_spacing, F.lit(float(width + x_spacing)))).cast("int")
    n_r = F.lit(rows) if height is None else F.floor(F.try_divide(F.col("height") + y_spacing, F.lit(float(height + y_spacing)))).cast("int")
    w = (F.col("width") - (n_c - 1) * x_spacing) / n_c if width is None else F.lit(float(width))
    h = (F.col("height") - (n_r - 1) * y_spacing) / n_r if height is None else F.lit(float(height))
    grid = r.withColumns({"n_c": n_c, "n_r": n_r, "w": w, "h": h}).where("w > 0 and h > 0 and n_c > 0 and n_r > 0")
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_r") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)))
    s, t = F.col("col") * (F.col("w") + x_spacing), F.col("row") * (F.col("h") + y_spacing)

    def corner(a: Column, b: Column) -> Column:
        return geom.point(F.col("ox") + a * F.col("ux") + b * F.col("vx"), F.col("oy") + a * F.col("uy") + b * F.col("vy"))

    ring = F.array(corner(s, t), corner(s + F.col("w"), t), corner(s + F.col("w"), t + F.col("h")), corner(s, t + F.col("h")), corner(s, t))
    cells = keep_cells(grid.select(*by, "row", "col", ring.alias("ring")), boundaries, keep, by=by)
    number = F.row_number().over(W.partitionBy(*by).orderBy("row", "col")).cast("long")
    return cells.select(*by, number.alias("id"), "row", "col", "ring")


def write_subplots(cells: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> str:
    """Writes subplots (by.., id, row, col, ring) partitioned by key, with closed rings; the path gets the format's suffix once."""
    path = path if path.lower().endswith(f".{fmt}") else f"{path}.{fmt}"
    cells.withColumn("ring", geom.close_ring(F.col("ring"))).write.mode(mode).partitionBy(*(by or BY)).format(fmt).save(path)
    return path
