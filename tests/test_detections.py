"""Literal cases of suppression, merging, sources, points, names and edits."""

import random

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import geom
from fieldspark.operators import labels, polygons, rasters, suppress
from fieldspark.operators import points as pt
from fieldspark.sources import tables
from fieldspark.streaming import edits as ed

BOXES = "raster_id long, row int, col int, idx long, gx0 double, gy0 double, gx1 double, gy1 double, score double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, 0, 0, i, *map(float, r)) for i, r in enumerate(rows)], BOXES)


def test_nms(spark):
    kept = suppress.nms(boxes(spark, (0, 0, 10, 10, 0.7), (1, 1, 11, 11, 0.9), (30, 30, 40, 40, 0.8)), 0.5).orderBy("rank").collect()
    assert [r.idx for r in kept] == [1, 2]
    kept = suppress.nms(boxes(spark, (0, 0, 30, 30, 0.95), (5, 5, 15, 15, 0.9), (50, 50, 70, 70, 0.7)), 0.9, 0.95).orderBy("rank").collect()
    assert [r.idx for r in kept] == [0, 2]


def test_nms_against_a_plain_loop(spark):
    random.seed(1)
    rows = []
    for i in range(150):
        x, y, s = random.random() * 40, random.random() * 40, 2 + random.random() * 12
        rows.append((x, y, x + s, y + s, random.random()))

    def iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return inter / max((a[2] - a[0]) ** 2 + (b[2] - b[0]) ** 2 - inter, 1e-9)

    kept = []
    for i in sorted(range(150), key=lambda i: -rows[i][4]):
        if all(iou(rows[i], rows[j]) <= 0.2 for j in kept):
            kept.append(i)
    assert sorted(r.idx for r in suppress.nms(boxes(spark, *rows), 0.2).collect()) == sorted(kept)


def test_merge(spark):
    df = spark.createDataFrame([(1, s, 0, i, *map(float, b)) for s in (0, 1) for i, b in enumerate([(0, 0, 10, 10, 0.9 - s / 10), (30, 30, 40, 40, 0.8 - s / 10)])], BOXES)
    merged = suppress.merge_detections(df)
    assert [r.score for r in merged.orderBy("rank").collect()] == [0.9, 0.8]
    b, p, g = suppress.export_frames(merged)
    assert [r.fid for r in p.orderBy("fid").collect()] == [0, 1] and b.count() == g.count() == 2
    assert suppress.merge_detections(df.limit(0)).count() == 0


def test_border(spark):
    df = boxes(spark, (200, 100, 220, 120, 0.9)).withColumns({n: F.lit(v) for n, v in zip(("px0", "py0", "px1", "py1"), (0.5, 3.0, 20.0, 20.0), strict=True)}).withColumns({"slice_w": F.lit(64), "slice_h": F.lit(64)})

    def edge(left):
        return F.struct(F.lit(left).alias("left"), *[F.lit(False).alias(n) for n in ("top", "right", "bottom")])

    assert suppress.merge_detections(df.withColumn("edge", edge(False))).count() == 0
    assert suppress.merge_detections(df.withColumn("edge", edge(True))).count() == 1


def test_predictor_and_results(spark):
    r = spark.createDataFrame([(1, 32, 32, 1.0, 0.0, 0.0, 0.0, -1.0, 32.0)], "raster_id long, width int, height int, a double, b double, c double, d double, e double, f double")
    w = rasters.slice_windows(r, 16, 0)
    assert w.count() == 4
    ring = [(1.0, 2.0), (5.0, 2.0), (5.0, 6.0), (1.0, 6.0)]

    def factory():
        def predict(rows):
            out = rows[["raster_id", "row", "col"]].assign(idx=0, score=None)
            out["polygon"] = [[{"x": x, "y": y} for x, y in ring]] * len(out)
            return out

        return predict

    found = rasters.detect(w.select("raster_id", "row", "col"), factory, "raster_id long, row int, col int, idx long, score double, polygon array<struct<x:double,y:double>>")
    rows = rasters.slice_results(found, w).orderBy("row", "col").collect()
    assert len(rows) == 4 and (rows[0].px0, rows[0].gx1, rows[0].gy0, rows[0].score) == (1, 5, 26, 1.0)
    short = found.withColumn("polygon", F.slice("polygon", 1, 1))
    assert rasters.slice_results(short, w).count() == 0


def test_points_and_boundaries(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.9, 0.9), (1, 2.0, 2.0)], "field_id long, x double, y double")
    assert [r.fid for r in pt.normalize_points(p).orderBy("x").collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="Point"):
        pt.normalize_points(p.drop("x"))
    ring = F.array(*[geom.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((-0.5, -0.5), (1.5, -0.5), (1.5, 1.5))])
    b = spark.range(1).select(F.lit(1).cast("long").alias("field_id"), F.lit(0).alias("part_id"), F.array(ring).alias("rings"))
    rows = pt.prepare_points(p, b).orderBy("fid").collect()
    assert [r.effective for r in rows] == [True, True, False]
    assert pt.prepare_points(p).where("effective").count() == 3
    with pytest.raises(ValueError, match="empty"):
        pt.check_boundaries(b.limit(0))
    with pytest.raises(ValueError):
        pt.check_boundaries(b.union(b), single=True)
    turned = pt.align_crs(b.withColumn("crs", F.lit("EPSG:4326")), "EPSG:3857")
    assert turned.first().crs == "EPSG:3857" and turned.first().rings[0][1].x == pytest.approx(166979.2, abs=1)
    assert polygons.boundary_axes(b).first().xx == pytest.approx(2**-0.5, abs=1) and pt.effective_points(pt.prepare_points(p, b)).count() == 2


def test_round_trips(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, 1.5, 2.5, "model", 0.1234567)], "field_id long, fid long, x double, y double, source string, conf double")
    for fmt in ("parquet", "json", "csv"):
        tables.write_points(p, f"{tmp_path}/{fmt}", fmt)
        r = tables.read_points(spark, f"{tmp_path}/{fmt}", fmt, p.schema).first()
        assert (r.field_id, r.fid, r.x, r.y, r.conf) == (1, 0, 1.5, 2.5, 0.123457)
    with pytest.raises(TypeError):
        tables.read_points(spark, 5)
    merged = suppress.merge_detections(boxes(spark, (0, 0, 10, 10, 0.9)))
    out = tables.export_detections(merged, f"{tmp_path}/run", crs="EPSG:3857")
    assert {n: spark.read.parquet(v).count() for n, v in out.items()} == {"bbox": 1, "points": 1, "polygon": 1}
    assert len(spark.read.parquet(out["bbox"]).first().polygon) == 5
    tables.save_run(merged, f"{tmp_path}/saved", "a")
    assert tables.load_run(spark, f"{tmp_path}/saved", "a").first().polygon[0].x == 0


def test_names(spark):
    names = spark.createDataFrame([(1, "demo")], "id long, name string")
    taken = spark.createDataFrame([("demo",), ("demo_1",)], "name string")
    assert labels.unique_names(names, taken).first().unique_name == "demo_2"
    paths = spark.createDataFrame([("/a/x/f.tif",), ("/a/y/f.tif",), ("/a/z/g.tif",)], "path string")
    assert {r.path: r.name for r in labels.catalog_names(paths).collect()} == {"/a/x/f.tif": "f (.../x/...)", "/a/y/f.tif": "f (.../y/...)", "/a/z/g.tif": "g"}


EDITS = "field_id long, seq long, action string, fid long, x double, y double"


def test_edits(spark):
    log = [(1, 0, "add", None, 10.0, 20.0), (1, 1, "move", 0, 11.5, 22.5), (1, 2, "delete", 0, None, None), (1, 3, "undo", None, None, None), (1, 4, "undo", None, None, None), (1, 5, "undo", None, None, None), (1, 6, "undo", None, None, None), (1, 7, "add", None, 1.0, 1.0), (1, 8, "move", 99, 0.0, 0.0)]
    expected = {3: [], 4: [(0, 11.5)], 5: [(0, 10.0)], 6: [], 7: [], 8: [(1, 1.0)], 9: [(1, 1.0)]}
    for n, points in expected.items():
        rows = ed.replay(spark.createDataFrame(log[:n], EDITS)).collect()
        assert [(r.fid, r.x) for r in rows] == points, n


def test_results_do_not_depend_on_partitions(spark):
    random.seed(3)
    rows = [(random.random() * 50, random.random() * 50) for _ in range(80)]
    df = boxes(spark, *[(x, y, x + 9, y + 9, round(random.random(), 1)) for x, y in rows])
    found = set()
    for n in ("1", "7", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.add(tuple(sorted(r.idx for r in suppress.nms(df.repartition(int(n)), 0.2, 0.9).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 1


@pytest.mark.parametrize(("at_once", "few"), [(1_000_000, 20_000), (1_000_000, 0), (40, 0), (3, 0)])
def test_chains_are_decided_alike_at_once_and_in_rounds(spark, at_once, few):
    """Ten chains in one key and one in another: walked in one list, by key, by component, and in rounds."""
    rows = [(1 + (c == 10), 0, 0, 100 * c + i, 5.0 * i, 50.0 * c, 5.0 * i + 9, 50.0 * c + 9, 1 - (100 * c + i) / 5000) for c in range(11) for i in range(12)]
    df = suppress.ranked(spark.createDataFrame(rows, BOXES), ["raster_id"])
    kept = suppress.greedy_suppress(df, suppress.box_conflicts(df, geom.iou, 0.2, ["raster_id"]), ["raster_id", "rank"], at_once=at_once, few=few)
    assert sorted(r.idx for r in kept.collect()) == [100 * c + i for c in range(11) for i in range(0, 12, 2)]


def test_windows_off_the_tiles_are_zeros(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 2, 2, b, [float(b)] * 4) for b in (1, 2, 4)], "raster_id long, tile_row int, tile_col int, tile_w int, tile_h int, band int, pixels array<double>")
    windows = [(1, 0, 0, 1, -1, 3, 1), (1, 0, 1, 90, 90, 92, 91), (2, 0, 0, 0, 0, 2, 1), (1, 9, 9, 5, 5, 5, 8)]
    affine = {n: F.lit(v) for n, v in zip("abcdef", (0.5, 0.0, 10.0, 0.0, -0.5, 90.0), strict=True)}
    w = spark.createDataFrame(windows, "raster_id long, row int, col int, x0 int, y0 int, x1 int, y1 int").withColumns(affine)
    got = {(r.raster_id, r.col, r.band): (r.pixels, r.c, r.f) for r in rasters.read_windows(tiles, w).collect()}
    assert got == {(1, 0, b): ([0.0, 0.0, float(b), 0.0], 10.5, 90.5) for b in (1, 2)} | {(1, 1, b): ([0.0, 0.0], 55.0, 45.0) for b in (1, 2)} | {(2, 0, 1): ([0.0, 0.0], 10.0, 90.0)}


@pytest.mark.parametrize("peeled", [0, 4])
def test_a_component_larger_than_a_walk(spark, monkeypatch, peeled):
    """One long chain and one thicket, walked in blocks of rank as in one list."""
    monkeypatch.setattr(suppress, "PEELED", peeled)
    rng = random.Random(9)
    rows = [(1, 0, 0, i, 5.0 * i, 0.0, 5.0 * i + 9, 9.0, 1 - i / 5000) for i in range(300)]
    rows += [(2, 0, 0, i, x, y, x + 12, y + 12, round(rng.random(), 2)) for i, (x, y) in enumerate((rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(120))]
    df = suppress.ranked(spark.createDataFrame(rows, BOXES), ["raster_id"])
    conflicts = suppress.box_conflicts(df, geom.iou, 0.1, ["raster_id"])
    once = suppress.greedy_suppress(df, conflicts, ["raster_id", "rank"])
    want = sorted((r.raster_id, r.idx) for r in once.collect())
    assert len([w for w in want if w[0] == 1]) == 150 and 10 < len([w for w in want if w[0] == 2]) < 60
    blocks = suppress.greedy_suppress(df, conflicts, ["raster_id", "rank"], at_once=90, few=0)
    assert sorted((r.raster_id, r.idx) for r in blocks.collect()) == want


def crowd(spark, n):
    random.seed(3)
    rows = []
    for i in range(n):
        x, y, s = random.gauss(0, 6), random.gauss(0, 6), random.choice((5.0, 5.5, 9.0))
        rows.append((i % 2, 0, 0, i, x, y, x + s, y + s, round(random.random(), 2)))
    return spark.createDataFrame([*rows, (None, 0, 0, n, 0.0, 0.0, 5.0, 5.0, 0.5), (None, 0, 0, n + 1, 0.0, 0.0, 5.0, 5.0, 0.5)], BOXES)


def test_conflicts_of_a_crowd_are_not_all_listed(spark, monkeypatch):
    n, listed, plain = 4000, [], suppress.greedy_suppress
    df = crowd(spark, n)

    def counted(nodes, conflicts, keys, *more, **how):
        listed.append(conflicts.count())
        return plain(nodes, conflicts, keys, *more, **how)

    monkeypatch.setattr(suppress, "greedy_suppress", counted)
    found = sorted(r.idx for r in suppress.nms(df, 0.1).collect())
    assert max(listed) <= 2 * suppress.WHOLE  # all conflicts are 677,774
    monkeypatch.setattr(suppress, "greedy_suppress", plain)
    ranked = suppress.ranked(df, ["raster_id"])
    whole = plain(ranked, suppress.box_conflicts(ranked, geom.iou, 0.1, ["raster_id"]), ["raster_id", "rank"])
    assert found == sorted(r.idx for r in whole.collect()) and {n, n + 1} <= set(found)


@pytest.mark.parametrize("in_pixels", [False, True])
def test_crops_of_one_field_are_many_tasks(spark, in_pixels):
    points = spark.range(0, 200, 1, 1).selectExpr("id % 2 * 0 + 7 as field_id", "id as fid", "id / 3 as x", "id / 7 as y")
    dated = spark.range(0, 50, 1, 1).selectExpr("id % 2 * 0 + 7 as field_id", "id as raster_id", "0.5D as a", "0D as b", "0D as c", "0D as d", "-0.5D as e", "0D as f", "id as date")
    rows = rasters.crop_windows(points, dated, 3.0, in_pixels, digits=3)
    assert rows.columns == ["field_id", "fid", "x", "y", "raster_id", "a", "b", "c", "d", "e", "f", "date", "left", "bottom", "right", "top"]
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == rows.select("fid", "raster_id").distinct().count() == 200 * 50 and max(sizes) < 0.6 * sum(sizes)
    one = rows.where("fid = 100 and raster_id = 9").first()
    half = 0.75 if in_pixels else 1.5
    assert (one.left, one.top) == (round(100 / 3 - half, 3), round(100 / 7 + half, 3))


def test_normalized_crops_read_their_windows_once(spark):
    tiles = spark.createDataFrame([(1, 0, c, 2, 2, b, [1.0 * b, 2.0, 3.0, 4.0 + c + b]) for c in (0, 1) for b in (1, 2)], "raster_id long, tile_row int, tile_col int, tile_w int, tile_h int, band int, pixels array<double>")
    windows = spark.createDataFrame([(1, 5, 1, 0, 4, 3), (2, 6, 0, 0, 1, 1)], "raster_id long, center_id long, x0 int, y0 int, x1 int, y1 int")
    keys = ["raster_id", "center_id"]
    rows = rasters.normalize_images(rasters.read_windows(tiles, windows, keys), keys)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("explode(sequence(cy0") == 1
    found = {(r.raster_id, r.band): r.pixels for r in rows.collect()}
    scaled = lambda *v: [int(x / 7 * 255) for x in v]  # noqa: E731  the greatest value of both bands is 7
    assert found == {(1, 1): scaled(2, 1, 2, 5, 3, 6, 0, 0, 0), (1, 2): scaled(2, 2, 2, 6, 3, 7, 0, 0, 0), (2, 1): [0]}
