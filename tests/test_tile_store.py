"""Tiles that windows prune, crops over dates, and boxes of a report as rows."""

import re

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import rasters
from fieldspark.sources import tables, tile_store

AFFINE = dict(zip("abcdef", (1.0, 0.0, 0.0, 0.0, -1.0, 64.0), strict=True))


@pytest.fixture(scope="module")
def tiles(spark):
    """Six rasters of 8 by 8 tiles of 8 by 8 pixels, the last column narrower; a pixel's value tells its place."""
    cells = spark.range(6 * 64).select(F.floor(F.col("id") / 64).alias("raster_id"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("tile_row"), (F.col("id") % 8).cast("int").alias("tile_col"))
    width = F.when(F.col("tile_col") == 7, 3).otherwise(8)
    at = lambda i: (F.col("tile_row") * 8 + F.floor(i / width)) * 100 + F.col("tile_col") * 8 + i % width
    pixels = F.transform(F.sequence(F.lit(0), width * 8 - 1), lambda i: at(i).cast("double"))
    return cells.select("*", width.alias("tile_w"), F.lit(8).alias("tile_h"), F.lit(1).alias("band"), pixels.alias("pixels"))


def test_windows_prune_folders_and_rows(spark, tiles, tmp_path):
    path = tile_store.write_tiles(tiles, str(tmp_path / "tiles"))
    rows = [(2, 0, 0, 10, 10, 20, 20), (4, 1, 0, -5, 18, 3, 26), (4, 1, 1, 55, 12, 59, 16), (5, 0, 0, 5, 5, 5, 9)]
    windows = spark.createDataFrame(rows, "raster_id long, row int, col int, x0 int, y0 int, x1 int, y1 int")
    some = tile_store.read_tiles(spark, path, windows)
    assert {r.raster_id for r in some.select("raster_id").distinct().collect()} == {2, 4}
    assert some.count() < tiles.where("raster_id in (2, 4)").count()
    plan = some._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*raster_id", plan), plan
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(tile_col", plan), plan
    by = lambda df: sorted((r.raster_id, r.row, r.col, r.pixels) for r in rasters.read_windows(df, windows).collect())
    assert by(some) == by(tiles) == by(tile_store.read_tiles(spark, path))
    assert tile_store.read_tiles(spark, path, windows.limit(0)).count() == 0


def test_more_rasters_than_are_named(spark, tiles, tmp_path, monkeypatch):
    monkeypatch.setattr(tile_store, "NAMED", 1)
    path = tile_store.write_tiles(tiles, str(tmp_path / "tiles"))
    windows = spark.createDataFrame([(k, 0, 0, 8, 8, 12, 12) for k in range(6)], "raster_id long, row int, col int, x0 int, y0 int, x1 int, y1 int")
    by = lambda df: sorted((r.raster_id, r.pixels) for r in rasters.read_windows(df, windows).collect())
    assert by(tile_store.read_tiles(spark, path, windows)) == by(tiles)


def test_series_of_crops(spark, tiles):
    dated = spark.createDataFrame([(1, k, f"d{k}", *AFFINE.values()) for k in (0, 3)] + [(2, 1, "d1", *AFFINE.values())], "field_id int, raster_id long, date string, a double, b double, c double, d double, e double, f double")
    points = spark.createDataFrame([(1, 10, 20.0, 40.0), (1, 11, 0.0, 64.0), (2, 10, 30.0, 30.0), (3, 10, 5.0, 5.0)], "field_id int, fid long, x double, y double")
    out = {(r.field_id, r.fid, r.raster_id): r for r in rasters.crop_series(points, dated, tiles, 4.0).collect()}
    assert set(out) == {(1, 10, 0), (1, 10, 3), (1, 11, 0), (1, 11, 3), (2, 10, 1)}
    got = out[1, 10, 3]
    raw = [(y * 100 + x) for y in range(22, 26) for x in range(18, 22)]
    assert (got.x0, got.y0, got.date) == (18, 22, "d3") and list(got.pixels) == [int(v / max(raw) * 255) for v in raw]
    edge = out[1, 11, 0]  # half of it lies off the raster
    assert edge.x0 == -2 and list(edge.pixels)[:8] == [0] * 8 and len(edge.pixels) == 16


def test_boxes_of_a_report_are_rows(spark):
    rows = [(1, 0, 0, i, float(i), 0.0, float(i + 2), 4.0, None if i == 3 else (i % 5) / 5) for i in range(40)]
    found = spark.createDataFrame(rows, "raster_id long, row int, col int, idx long, gx0 double, gy0 double, gx1 double, gy1 double, score double")
    got = sorted(tables.report_boxes(found).collect(), key=lambda r: r.k)
    want = sorted(rows, key=lambda r: (r[8] is None, -(r[8] or 0), r[3]))
    assert [(r.k, r.idx, r.score, r.cx, r.cy) for r in got] == [(k, r[3], r[8], r[3] + 1.0, 2.0) for k, r in enumerate(want, 1)]
    assert sorted(r.idx for r in tables.report_boxes(found, best=3).collect()) == sorted(r[3] for r in want[:3])
    windows = found.select("raster_id", "row", "col").distinct().unionByName(spark.createDataFrame([(1, 5, 5)], "raster_id long, row int, col int"))
    assert sorted((r.row, r.n, r.max_score) for r in tables.slice_report(found, windows).collect()) == [(0, 40, 0.8), (5, 0, None)]
