"""Hierarchical grids and the slab index, against every pair and every edge."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.checkpoint import Scratch
from fieldspark.functions import predicates as pr
from fieldspark.operators import grids, polygons, suppress

BOX = "k int, {0} long, {0}x0 double, {0}y0 double, {0}x1 double, {0}y1 double"


def boxes(rng, n, name, spark):
    """Sizes over six orders of magnitude, some without width, some touching, some unusable."""
    rows = []
    for i in range(n):
        side = 10 ** rng.uniform(-3, 3) if i % 7 else rng.choice([0.0, 1.0, 2.0, 1024.0])
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        if i % 5 == 0:
            x, y = float(round(x)), float(round(y))
        rows.append((rng.randrange(2), i, x, y, x + side, y + side * rng.choice([0.01, 1])))
    rows += [(0, n, None, 0.0, 1.0, 1.0), (0, n + 1, 5.0, 5.0, 4.0, 6.0)]
    return rows, spark.createDataFrame(rows, BOX.format(name))


def test_boxes_of_any_size_meet_once(spark):
    rng = random.Random(3)
    a, left = boxes(rng, 150, "a", spark)
    b, right = boxes(rng, 200, "b", spark)
    got = grids.box_pairs(left, right, ["k"], ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"))
    want = sorted(
        (p[1], q[1]) for p in a[:-2] for q in b[:-2] if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]
    )
    assert sorted((r.a, r.b) for r in got.collect()) == want and len(want) > 500


def test_one_wide_box_is_few_rows(spark):
    """A box 10,000 times as wide as the rest stands in four cells, not in a cell for each of its neighbours' size."""
    small = spark.range(2000).select(F.lit(0).alias("raster_id"), F.col("id").alias("idx"), (F.col("id") % 100).cast("double").alias("gx0"), F.floor(F.col("id") / 100).cast("double").alias("gy0"))
    small = small.withColumns({"gx1": F.col("gx0") + 0.9, "gy1": F.col("gy0") + 0.9})
    wide = small.where("idx = 0").withColumns({"idx": F.lit(9999).cast("long"), "gx0": F.lit(-1.0), "gy0": F.lit(-1.0), "gx1": F.lit(9000.0), "gy1": F.lit(9000.0)})
    rows = small.unionByName(wide)
    cells = grids._cells(rows, ("gx0", "gy0", "gx1", "gy1"), grids._levels(rows, ("gx0", "gy0", "gx1", "gy1")), "a")
    assert cells.count() <= 4 * 2 * 2001
    kept = suppress.nms(rows.withColumns({"score": F.lit(0.5), "row": F.lit(0), "col": F.lit(0)}), iou=0.5, ios=0.95)
    assert sorted(r.idx for r in kept.collect()) == list(range(2000))  # the wide box ranks last and lies over the others


def star(rng, cx, cy, r, n):
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.fixture(scope="module")
def boundaries(spark):
    """Stars, rectangles with shared edges, a hole, a concave part with a notch, a part without area, and one that is no polygon."""
    rng = random.Random(5)
    square = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rows = [(1, [star(rng, rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(2, 15), rng.choice([3, 8, 60]))]) for _ in range(6)]
    rows += [(2, [square(0, 0, 10, 10)]), (2, [square(10, 0, 10, 10)]), (2, [square(0, 20, 20, 20), square(5, 25, 10, 10)])]
    rows += [(2, [[(30, 0), (40, 0), (40, 10), (36, 10), (36, 4), (34, 4), (34, 10), (30, 10)]]), (2, [[(0, 50), (10, 50), (20, 50)]]), (3, [[(0, 0), (1, 1)]]), (4, None)]
    data = [(k, None if rings is None else [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in rows]
    return spark.createDataFrame(data, "field_id int, rings array<array<struct<x:double,y:double>>>").coalesce(2)


def test_points_against_every_edge(spark, boundaries):
    rng = random.Random(6)
    spots = [(i, rng.choice([1, 2, 3, 4, 5]), rng.uniform(-2, 45), rng.uniform(-2, 45)) for i in range(1500)]
    spots += [(2000 + i, 2, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(0, 42) for y in range(0, 52, 2))]
    spots.append((9999, 1, None, 1.0))
    points = spark.createDataFrame(spots, "fid long, field_id int, x double, y double")
    parts = boundaries.select("field_id", pr.all_edges(F.col("rings")).alias("edges")).where(F.size("edges") > 0)
    inside = {r.fid for r in points.join(parts, "field_id").where(pr.covers(F.col("edges"), F.col("x"), F.col("y"))).collect()}
    got = {r.fid: r.effective for r in polygons.effective_mask(points, boundaries).collect()}
    assert got == {i: i in inside or k == 5 for i, k, *_ in spots}
    assert 100 < len(inside) < len(spots)


@pytest.mark.parametrize("mode", ["touch", "inside"])
def test_cells_against_every_edge(spark, boundaries, mode):
    rng = random.Random(7)
    rows = []
    for i in range(500):
        x, y, w, h, turn = rng.uniform(-2, 42), rng.uniform(-2, 52), rng.uniform(0.2, 6), rng.uniform(0.2, 6), rng.choice([0, 0, 0.4])
        if i % 2:
            x, y, w, h, turn = float(round(x)), float(round(y)), float(rng.choice([1, 2, 4, 10, 30])), float(rng.choice([1, 2, 4, 10])), 0
        ring = [(x + a * w * math.cos(turn) - b * h * math.sin(turn), y + a * w * math.sin(turn) + b * h * math.cos(turn)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
        rows.append((i, rng.choice([1, 2, 2, 3, 5]), ring))
    cells = spark.createDataFrame(rows, "cell int, field_id int, ring array<struct<x:double,y:double>>")
    parts = boundaries.select("field_id", pr.all_edges(F.col("rings")).alias("edges")).where(F.size("edges") > 0)
    test = pr.within if mode == "inside" else pr.intersects
    every = cells.withColumn("sides", pr.edges(F.col("ring"))).join(parts, "field_id")
    want = {r.cell for r in every.where(test(F.col("ring"), F.col("sides"), F.col("edges"))).collect()}
    free = {i for i, k, _ in rows if k in (3, 5)}  # keys without a usable boundary keep all
    out = polygons.keep_cells(cells, boundaries, mode)
    assert out.columns == cells.columns
    assert sorted(r.cell for r in out.collect()) == sorted(want | free)
    assert len(want) > 20


def test_a_boundary_of_many_vertices(spark):
    """A hundred thousand vertices: a point meets a few edges, a window those near it."""
    n = 100_000
    angle = F.lit(2 * math.pi / n) * F.col("id")
    r = F.lit(1000.0) + F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0)
    vertex = F.struct((r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))
    ring = spark.range(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", vertex.alias("v")))), lambda s: s["v"]).alias("ring"))
    boundary = ring.select(F.lit(1).alias("field_id"), F.array("ring").alias("rings"))
    index = grids.boundary_index(boundary, ["field_id"], Scratch(spark))
    assert index.edges.count() == n and index.slabs.count() <= 4 * n
    assert index.slabs.groupBy("nr").count().agg(F.avg("count")).first()[0] <= 100
    points = spark.range(4_000).select(F.lit(1).alias("field_id"), F.col("id").alias("fid"), (F.rand(1) * 2400 - 1200).alias("x"), (F.rand(2) * 2400 - 1200).alias("y"))
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    got = polygons.effective_mask(points, boundary).where((far < 999) | (far > 1002))
    assert got.where(F.col("effective") != (far < 1000)).count() == 0
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    cells = points.withColumn("ring", F.array(corner(0, 0), corner(5, 0), corner(5, 5), corner(0, 5)))
    for mode, low, high in (("inside", 990, 1002), ("touch", 998, 1010)):
        kept = polygons.keep_cells(cells, boundary, mode).select("fid").withColumn("kept", F.lit(True))
        odd = cells.join(kept, "fid", "left").where(((far < low) & F.col("kept").isNull()) | ((far > high) & F.col("kept").isNotNull()))
        assert odd.count() == 0


def test_pairs_of_one_large_key_are_many_blocks(spark):
    a = spark.range(400).selectExpr("id % 2 * 0 as k", "id as a")
    b = spark.range(300).selectExpr("cast(0 as bigint) as k", "id as b")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small blocks are put together
    try:
        pairs = grids.all_pairs(a, b, ["k"], "a", "b")
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == pairs.distinct().count() == 400 * 300
        assert len(sizes) == 4 and max(sizes) < 0.6 * sum(sizes)  # the session has four partitions
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    one = grids.all_pairs(a, b, ["k"], "a", "b", 32, 1)
    assert one.count() == one.distinct().count() == 400 * 300
