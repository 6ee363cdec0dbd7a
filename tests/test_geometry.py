"""Literal cases of geometry, windows and predicates."""

import math

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import geom
from fieldspark.functions import predicates as pr
from fieldspark.operators import polygons, rasters


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_boxes_and_squares(spark):
    t = tuple(lit(0.1, 0, 100, 0, -0.1, 200))
    got = one(
        spark,
        centre=F.array(*geom.box_center(*lit(2, 2, 6, 6))),
        square=F.array(*geom.square_around(*lit(100, 200, 640))),
        pixels=F.array(*geom.pixel_square_from_geo(*lit(110, 190, 640), t)),
        small=geom.clamp_size(F.lit(64)),
        large=geom.clamp_size(F.lit(4096)),
        box=F.array(*geom.polygon_box(F.array(*[geom.point(*lit(*p)) for p in ((1, 2), (5, 2), (5, 6), (1, 6))]))),
    )
    assert got["centre"] == [4, 4]
    assert got["square"] == [-220, -120, 420, 520]
    assert got["pixels"] == pytest.approx([78, 158, 142, 222])
    assert (got["small"], got["large"]) == (128, 2048)
    assert got["box"] == [1, 2, 5, 6]


def test_directions_and_bins(spark):
    ux, uy = geom.unit_vector(*lit(3, 4))
    nx, _ = geom.unit_vector(*lit(0, 0))
    got = one(
        spark, ux=ux, uy=uy, none=nx, up=geom.angle_to_y(*lit(0, 1)), right=geom.angle_to_y(*lit(1, 0)), left=geom.angle_to_y(*lit(-1, 0)),
        one=geom.metres_to_bins(*lit(0.2, 1)), three=geom.metres_to_bins(*lit(1.1, 0.5)), zero=geom.metres_to_bins(*lit(0, 1)),
    )
    assert (got["ux"], got["uy"], got["none"]) == (0.6, 0.8, None)
    assert (got["up"], got["right"], got["left"]) == (0, -90, 90)
    assert (got["one"], got["three"], got["zero"]) == (1, 3, 1)


def test_rings_and_reprojection(spark):
    open_ring = F.array(*[geom.point(*lit(*p)) for p in ((0, 0), (1, 0), (1, 1))])
    x, y = geom.reproject(*lit(90, 45), "EPSG:4326", "EPSG:3857")
    bx, by = geom.reproject(x, y, "EPSG:3857", "EPSG:4326")
    got = one(spark, closed=F.size(geom.close_ring(open_ring)), again=F.size(geom.close_ring(geom.box_ring(*lit(0, 0, 1, 1)))), x=x, bx=bx, by=by)
    assert (got["closed"], got["again"]) == (4, 5)
    assert got["x"] == pytest.approx(math.pi / 2 * geom.EARTH)
    assert (got["bx"], got["by"]) == (pytest.approx(90), pytest.approx(45))
    with pytest.raises(ValueError):
        geom.reproject(*lit(0, 0), "EPSG:4326", "EPSG:2154")  # a conic, without a series here


def test_edges_of_a_polygon_belong_to_it(spark):
    triangle = F.array(*[geom.point(*lit(*p)) for p in ((-0.5, -0.5), (1.5, -0.5), (1.5, 1.5))])
    hole = F.array(*[geom.point(*lit(*p)) for p in ((1, 0), (1.2, 0), (1.2, 0.2))])
    plain, holed = pr.all_edges(F.array(triangle)), pr.all_edges(F.array(triangle, hole))
    points = spark.createDataFrame([(0.0, 0.0, True, True), (0.9, 0.9, True, True), (2.0, 2.0, False, False), (1.15, 0.05, True, False)], "x double, y double, plain boolean, holed boolean")
    rows = points.select("*", pr.covers(plain, F.col("x"), F.col("y")).alias("a"), pr.covers(holed, F.col("x"), F.col("y")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(r.plain, r.holed) for r in rows]


def test_within_and_intersects(spark):
    ell = F.array(*[geom.point(*lit(*p)) for p in ((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))])
    boxes = [(0, 0, 1, 1, True, True), (0, 0, 4, 1, True, True), (0.5, 0.5, 2, 2, False, True), (2, 2, 3, 3, False, False), (4, 0, 5, 1, False, True), (-1, -1, 6, 6, False, True), (0, 1, 1, 2, True, True)]
    df = spark.createDataFrame([tuple(float(v) for v in b[:4]) + b[4:] for b in boxes], "x0 double, y0 double, x1 double, y1 double, inside boolean, touch boolean")
    df = df.withColumn("ring", geom.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).withColumn("e", pr.edges(F.col("ring")))
    df = df.withColumn("p", pr.all_edges(F.array(ell)))
    rows = df.select("inside", "touch", pr.within(F.col("ring"), F.col("e"), F.col("p")).alias("a"), pr.intersects(F.col("ring"), F.col("e"), F.col("p")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(r.inside, r.touch) for r in rows]


def test_windows(spark):
    r = spark.createDataFrame([(1, 1000, 1000)], "raster_id long, width int, height int")
    rows = rasters.slice_windows(r, 400, 0.5).orderBy("row", "col").collect()
    assert len(rows) == 16 and (rows[0].x0, rows[0].y0) == (0, 0) and (rows[-1].x1, rows[-1].y1) == (1000, 1000)
    small = spark.createDataFrame([(1, 100, 100, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "raster_id long, width int, height int, a double, b double, c double, d double, e double, f double")
    square = spark.range(1).select(F.lit(1).cast("long").alias("raster_id"), F.array(geom.box_ring(*lit(20, 20, 80, 80))).alias("rings"))
    touch, inside = (rasters.slice_grid(small, square, 40, 0, m).count() for m in ("touch", "inside"))
    assert touch >= inside > 0


def test_grid(spark):
    b = spark.range(1).select(F.lit(1).cast("long").alias("field_id"), F.lit(0).alias("part_id"), F.array(geom.box_ring(*lit(0, 0, 100, 100))).alias("rings"))
    cells = polygons.subplots(b, 2, 2, x_spacing=10, y_spacing=10).orderBy("id").collect()
    assert [c.id for c in cells] == [1, 2, 3, 4]
    ring = cells[0].ring
    assert max(p.x for p in ring) - min(p.x for p in ring) == pytest.approx(45)
    assert polygons.subplots(b, 2, 2, x_spacing=100, y_spacing=100).count() == 0
    assert polygons.subplots(b, width=30.0, height=45.0, x_spacing=5.0).count() == 6


def test_rectangle_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        p = rng.normal(size=(rng.integers(3, 30), 2))
        *_, w, h = polygons.rectangle(p)
        least = min(np.ptp(p @ [math.cos(a), math.sin(a)]) * np.ptp(p @ [-math.sin(a), math.cos(a)]) for a in np.linspace(0, math.pi / 2, 2000))
        assert w >= h - 1e-9 and w * h <= least + 1e-9
    assert polygons.rectangle(np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])) is None
