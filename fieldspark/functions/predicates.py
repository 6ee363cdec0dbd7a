"""Closed predicates over rings (arrays of struct<x, y>, open or closed) as column expressions.

Rings of one polygon count by parity, so a hole is a further ring. Edges belong to the polygon.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """array<struct<p, q>> of the ring's edges, the closing one too; none for fewer than three vertices."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    pairs = F.arrays_zip(ring.alias("p"), shifted.alias("q"))
    pairs = F.transform(pairs, lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q")))
    return F.when(F.size(ring) >= 3, F.filter(pairs, lambda e: e["p"] != e["q"])).otherwise(F.slice(pairs, 1, 0))


def all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, edges))


def _cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def on_edge(x: Column, y: Column, e: Column, eps: float = 1e-12) -> Column:
    p, q = e["p"], e["q"]
    size = F.abs(q["x"] - p["x"]) + F.abs(q["y"] - p["y"])
    flat = F.abs(_cross(p["x"], p["y"], q["x"], q["y"], x, y)) <= eps * F.greatest(size, F.lit(1.0))
    return flat & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))


def crossed(x: Column, y: Column, e: Column) -> Column:
    """Whether a ray from the point along +x crosses the edge."""
    p, q = e["p"], e["q"]
    at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
    return F.coalesce(((p["y"] > y) != (q["y"] > y)) & (x < at), F.lit(False))


def covers(edge_list: Column, x: Column, y: Column) -> Column:
    """Point in or on the polygon."""
    odd = F.aggregate(edge_list, F.lit(False), lambda a, e: a != crossed(x, y, e))
    return F.exists(edge_list, lambda e: on_edge(x, y, e)) | odd


def inside(edge_list: Column, x: Column, y: Column) -> Column:
    odd = F.aggregate(edge_list, F.lit(False), lambda a, e: a != crossed(x, y, e))
    return odd & ~F.exists(edge_list, lambda e: on_edge(x, y, e))


def _sides(e: Column, f: Column) -> tuple[Column, ...]:
    p, q, r, s = e["p"], e["q"], f["p"], f["q"]
    return (
        _cross(p["x"], p["y"], q["x"], q["y"], r["x"], r["y"]),
        _cross(p["x"], p["y"], q["x"], q["y"], s["x"], s["y"]),
        _cross(r["x"], r["y"], s["x"], s["y"], p["x"], p["y"]),
        _cross(r["x"], r["y"], s["x"], s["y"], q["x"], q["y"]),
    )


def cross_properly(e: Column, f: Column) -> Column:
    a, b, c, d = _sides(e, f)
    return (a * b < 0) & (c * d < 0)


def touch(e: Column, f: Column) -> Column:
    """Segments that share a point."""
    p, q, r, s = e["p"], e["q"], f["p"], f["q"]
    return cross_properly(e, f) | on_edge(r["x"], r["y"], e) | on_edge(s["x"], s["y"], e) | on_edge(p["x"], p["y"], f) | on_edge(q["x"], q["y"], f)


def intersects(cell: Column, cell_edges: Column, edge_list: Column) -> Column:
    """A ring and a polygon that share a point; touching counts."""
    v = F.get(cell, 0)
    return (
        F.exists(cell_edges, lambda e: F.exists(edge_list, lambda f: touch(e, f)))
        | covers(edge_list, v["x"], v["y"])
        | F.exists(edge_list, lambda f: covers(cell_edges, f["p"]["x"], f["p"]["y"]))
    )


def within(cell: Column, cell_edges: Column, edge_list: Column) -> Column:
    """A convex ring wholly in a polygon: vertices covered, no proper crossing, and no vertex or edge of the polygon inside it.

    Where edges touch, the middles of a cell's edges between touching vertices are tested too.
    """
    corners = F.forall(cell, lambda v: covers(edge_list, v["x"], v["y"]))
    crossing = F.exists(cell_edges, lambda e: F.exists(edge_list, lambda f: cross_properly(e, f)))
    inner = F.exists(edge_list, lambda f: inside(cell_edges, f["p"]["x"], f["p"]["y"]) | inside(cell_edges, (f["p"]["x"] + f["q"]["x"]) / 2, (f["p"]["y"] + f["q"]["y"]) / 2))

    def cuts(e: Column) -> Column:
        p, q = e["p"], e["q"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        size = F.nullif(dx * dx + dy * dy, F.lit(0.0))
        touching = F.filter(edge_list, lambda f: on_edge(f["p"]["x"], f["p"]["y"], e))
        at = F.transform(touching, lambda f: ((f["p"]["x"] - p["x"]) * dx + (f["p"]["y"] - p["y"]) * dy) / size)
        return F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), at))

    def middles(e: Column) -> Column:
        t = cuts(e)
        p, q = e["p"], e["q"]
        mid = F.zip_with(t, F.slice(t, 2, F.size(t)), lambda a, b: (a + b) / 2)
        mid = F.filter(mid, lambda m: m.isNotNull())
        return F.forall(mid, lambda m: covers(edge_list, p["x"] + m * (q["x"] - p["x"]), p["y"] + m * (q["y"] - p["y"])))

    return corners & ~crossing & ~inner & F.forall(cell_edges, middles)
