"""Raster tiles as a table that windows prune: a folder for each raster, clustered by tile row and column inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rasters that are named in a filter at most; beyond, only the join with the windows prunes.
NAMED = 10_000


def write_tiles(tiles: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Writes tiles (raster_id, tile_row, tile_col, tile_w, tile_h, band, pixels) in ranges of raster and place; returns path.

    A raster with many tiles is several files, each with a stretch of its rows, so row-group statistics tell where to look.
    """
    place = ["raster_id", "tile_row", "tile_col"]
    tiles.repartitionByRange(*place).sortWithinPartitions(*place).write.mode(mode).partitionBy("raster_id").parquet(path)
    return path


def read_tiles(spark: SparkSession, path: str, windows: DataFrame | None = None) -> DataFrame:
    """The tiles, or those that windows (raster_id, x0, y0, x1, y1) can need.

    Windows become filters: their rasters on folders, their outermost tile rows and columns on row groups. What comes to the driver is one row for each raster,
    at most ``NAMED``; with more rasters only the outermost rows and columns filter.
    """
    tiles = spark.read.parquet(path).withColumn("raster_id", F.col("raster_id").cast("long"))
    if windows is None:
        return tiles
    used = windows.where("x1 > x0 and y1 > y0")
    low = used.agg(*[F.min(c) for c in ("x0", "y0")], *[F.max(c) for c in ("x1", "y1")]).first()
    if low[0] is None:
        return tiles.where("false")
    rasters = [r[0] for r in used.select("raster_id").distinct().limit(NAMED + 1).collect()]
    if len(rasters) <= NAMED:
        tiles = tiles.where(F.col("raster_id").isin([r for r in rasters if r is not None]))
    # Tiles of a raster are equally wide but for the last, so the least width bounds where a window can reach.
    size = tiles.agg(F.max("tile_w"), F.max("tile_h")).first()
    if size[0] is None:
        return tiles
    x0, y0, x1, y1 = low
    reach = (F.col("tile_col") >= x0 // size[0] - 1) & (F.col("tile_row") >= y0 // size[1] - 1)
    sizes = tiles.where("tile_col = 0 and tile_row = 0").agg(F.min("tile_w"), F.min("tile_h")).first()
    if sizes[0]:
        reach = reach & (F.col("tile_col") <= x1 // sizes[0] + 1) & (F.col("tile_row") <= y1 // sizes[1] + 1)
    return tiles.where(reach)
