"""Boxes that meet, and polygons cut into edges, so that work follows what is near.

Boxes of any sizes meet through a hierarchy of grids: a box stands at the level of its own size (powers of two) in four
cells at most, and looks into the coarser levels that the other side has. Boundaries are tables of
edges with a slab index: a part's edges are dealt to horizontal slabs, so many that edges stand in about two slabs each, and a
point meets the edges of its slab only. No boundary is ever an array in one row after that.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import Scratch
from ..functions import predicates as pr

#: Boxes smaller than that have the level of that size.
LEAST = 2.0**-20


def _level(box: tuple[str, ...]) -> Column:
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return F.ceil(F.log2(F.greatest(x1 - x0, y1 - y0, F.lit(LEAST)))).cast("int")


def _levels(rows: DataFrame, box: tuple[str, ...]) -> list[int]:
    """The levels that occur: a few dozen at most, as sizes are doubles."""
    return sorted(r[0] for r in rows.select(_level(box)).distinct().collect() if r[0] is not None)


def _cells(rows: DataFrame, box: tuple[str, ...], others: list[int], side: str) -> DataFrame:
    """rows at their own level and at the coarser ones of the other side, in the cells that they cover."""
    own = f"level_{side}"
    rows = rows.withColumn(own, _level(box))
    coarser = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col(own))
    rows = rows.withColumn("level", F.explode(F.concat(F.array(own), coarser)))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    x0, y0, x1, y1 = box
    return rows.withColumn("cx", F.explode(F.sequence(at(x0), at(x1)))).withColumn("cy", F.explode(F.sequence(at(y0), at(y1))))


def box_pairs(a: DataFrame, b: DataFrame, by: list[str], box_a: tuple[str, ...], box_b: tuple[str, ...]) -> DataFrame:
    """All pairs of rows of one key whose boxes (x0, y0, x1, y1) share a point, once each.

    Other columns of a and b must have different names. A box with a null or a negative side meets nothing. A row becomes at most four for each level
    of size that the other side has.
    """
    ok = lambda box: f"{box[0]} <= {box[2]} and {box[1]} <= {box[3]}"
    a, b = a.where(ok(box_a)), b.where(ok(box_b))
    levels_a, levels_b = _levels(a, box_a), _levels(b, box_b)
    left, right = _cells(a, box_a, levels_b, "a"), _cells(b, box_b, levels_a, "b")
    pair = left.join(right, [*by, "level", "cx", "cy"]).where(F.col("level") == F.greatest("level_a", "level_b"))
    low_x, low_y = F.greatest(box_a[0], box_b[0]), F.greatest(box_a[1], box_b[1])
    meet = (low_x <= F.least(box_a[2], box_b[2])) & (low_y <= F.least(box_a[3], box_b[3]))
    home = lambda low, cell: F.floor(low / F.pow(F.lit(2.0), F.col("level"))) == F.col(cell)
    return pair.where(meet & home(low_x, "cx") & home(low_y, "cy")).drop("level", "cx", "cy", "level_a", "level_b")


def crowds(rows: DataFrame, by: list[str], box: tuple[str, ...]) -> DataFrame:
    """(by.., n, pairs): boxes of each key, and a bound on how many pairs of them share a point, from the boxes of each cell; null keys have none."""
    some = rows.where(f"{box[0]} <= {box[2]} and {box[1]} <= {box[3]}").dropna(subset=by).select(*by, *box)
    cells = _cells(some, box, _levels(some, box), "a")
    own = F.count_if(F.col("level") == F.col("level_a"))
    # Of boxes that stand in four cells each cell counts what meets there, so sums are bounds.
    held = cells.groupBy(*by, "level", "cx", "cy").agg(own.cast("double").alias("own"), F.count("*").alias("every"))
    pairs = held.groupBy(*by).agg(F.sum(F.col("own") * (F.col("every") - (F.col("own") + 1) / 2)).alias("pairs"))
    return some.groupBy(*by).agg(F.count("*").alias("n")).join(pairs, by)


def all_pairs(a: DataFrame, b: DataFrame, by: list[str], id_a: str, id_b: str, shares_a: int = 8, shares_b: int = 8) -> DataFrame:
    """Every row of a with every row of b of one key; other columns of a and b must have different names.

    A key's pairs are dealt to shares_a * shares_b blocks by the hash of the ids, so that a few large keys are no few long tasks. A row
    is repeated once for each share of the other side, and the blocks are merged from sorted rows, which spill.
    """
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.withColumn("_share_a", deal(id_a, shares_a)).withColumn("_share_b", every(shares_b))
    b = b.withColumn("_share_b", deal(id_b, shares_b)).withColumn("_share_a", every(shares_a))
    keys, parts = [*by, "_share_a", "_share_b"], max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # Work follows the pairs and not the bytes exchanged: partitions stay as many, and rows, more than Spark expects, are not broadcast.
    a, b = (rows.repartition(parts, *keys) for rows in (a, b))
    return a.join(b.hint("merge"), keys).drop("_share_a", "_share_b")


class Boundary(NamedTuple):
    """Parts of boundaries as tables: edges (by.., part, e, ex0..ey1), parts (by.., part, bx0..by1, slab) and slabs (by.., part, nr, e)."""

    by: list[str]
    edges: DataFrame
    parts: DataFrame
    slabs: DataFrame


EDGE, PART = ("ex0", "ey0", "ex1", "ey1"), ("bx0", "by0", "bx1", "by1")


def _slab(y: Column) -> Column:
    return F.floor((y - F.col("by0")) / F.col("slab"))


def boundary_index(boundaries: DataFrame, by: list[str], scratch: Scratch) -> Boundary:
    """The index of boundaries (by.., rings); each row is a part. Rows without an edge have none."""
    rows = boundaries.select(*by, "rings").withColumn("part", F.monotonically_increasing_id())  # before edges are rows
    rows = rows.select(*by, "part", F.explode(pr.all_edges(F.col("rings"))).alias("e"))
    low, high = (lambda c: F.least(F.col(f"e.p.{c}"), F.col(f"e.q.{c}"))), (lambda c: F.greatest(F.col(f"e.p.{c}"), F.col(f"e.q.{c}")))
    rows = rows.select("*", low("x").alias("ex0"), low("y").alias("ey0"), high("x").alias("ex1"), high("y").alias("ey1"))
    edges = scratch.written(rows, "edges")
    box = [F.min("ex0").alias("bx0"), F.min("ey0").alias("by0"), F.max("ex1").alias("bx1"), F.max("ey1").alias("by1")]
    parts = edges.groupBy(*by, "part").agg(*box, F.count("*").alias("n"), F.sum(F.col("ey1") - F.col("ey0")).alias("rise"))
    # With n * height / rise slabs the rises of all edges are n slabs together.
    height = F.col("by1") - F.col("by0")
    slab = F.when(height > 0, height / F.greatest(F.floor(F.col("n") * height / F.col("rise")), F.lit(1))).otherwise(1.0)
    parts = scratch.written(parts.select(*by, "part", *PART, slab.alias("slab")), "parts")
    nr = F.sequence(_slab(F.col("ey0")), _slab(F.col("ey1")))
    slabs = edges.join(parts.select(*by, "part", "by0", "slab"), [*by, "part"]).select(*by, "part", F.explode(nr).alias("nr"), "e")
    return Boundary(by, edges, parts, slabs)


def covered_points(points: DataFrame, index: Boundary, keys: list[str], part: str | None = None) -> DataFrame:
    """(by.., keys.., part) for each point (by.., keys.., x, y) in or on a part of its key; with a column part only that part is asked."""
    by = index.by
    if part is None:
        near = box_pairs(points.select(*by, *keys, "x", "y"), index.parts, by, ("x", "y", "x", "y"), PART)
    else:
        near = points.select(*by, *keys, part, "x", "y").join(index.parts, [*by, "part"]).where(F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1")))
    near = near.select(*by, *keys, "part", "x", "y", _slab(F.col("y")).alias("nr")).join(index.slabs, [*by, "part", "nr"])
    x, y, e = F.col("x"), F.col("y"), F.col("e")
    found = near.groupBy(*by, *keys, "part").agg(F.bit_xor(pr.crossed(x, y, e).cast("int")).alias("odd"), F.max(pr.on_edge(x, y, e)).alias("on"))
    return found.where("odd = 1 or on").select(*by, *keys, "part")
