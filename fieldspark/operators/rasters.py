"""Windows over rasters, pixels of windows from tiles, and batch detection with a predictor of the user's.

rasters: raster_id, width, height, affine a..f. tiles: raster_id, tile_row, tile_col, tile_w, tile_h, band, pixels (row by row).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geom
from .grids import all_pairs
from .polygons import keep_cells


def raster_catalog(rasters: DataFrame) -> DataFrame:
    """Adds left, bottom, right, top from affine and size."""
    x0, y0, x1, y1 = geom.boxes_pixel_to_geo(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    return rasters.withColumns({"left": x0, "bottom": y0, "right": x1, "top": y1})


def _starts(full: Column, size: int, stride: int) -> Column:
    last = F.greatest(full - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def slice_windows(rasters: DataFrame, size: int = 640, overlap: float = 0.2) -> DataFrame:
    """(raster_id, row, col, x0, y0, x1, y1) and the raster's columns: overlapping windows; the last ends at the edge."""
    if size < 1:
        raise ValueError(f"size may not be {size}")
    stride = max(1, int(size * (1 - min(max(overlap, 0.0), 0.95))))
    rows = rasters.select("*", F.posexplode(_starts(F.col("height"), size, stride)).alias("row", "y0"))
    rows = rows.select("*", F.posexplode(_starts(F.col("width"), size, stride)).alias("col", "x0"))
    return rows.withColumns({"x1": F.least(F.col("x0") + size, F.col("width")), "y1": F.least(F.col("y0") + size, F.col("height"))})


def window_edges(windows: DataFrame) -> DataFrame:
    """Adds edge and the window's size."""
    edge = geom.edge_flags(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("width"), F.col("height"))
    return windows.withColumns({"edge": edge, "slice_w": F.col("x1") - F.col("x0"), "slice_h": F.col("y1") - F.col("y0")})


def slice_grid(rasters: DataFrame, boundaries: DataFrame, size: int = 640, overlap: float = 0.2, mode: str = "touch") -> DataFrame:
    """Windows that touch ("touch") or lie in ("inside") their raster's boundaries, with their geo polygon as ring."""
    ring = geom.window_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return keep_cells(slice_windows(rasters, size, overlap).withColumn("ring", ring), boundaries, mode, by=["raster_id"])


def read_windows(tiles: DataFrame, windows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Windows with pixels array<double> row by row for each of the first three bands; what no tile has is 0.

    A window is joined to the keys of the tiles that it overlaps, and each tile gives only its rows inside the
    window, so pixels are never exploded one by one. Windows may reach over the raster or lie outside it; one of a raster without tiles
    has one band of zeros. If windows have their raster's affine a..f, the result has each window's own. Windows without area go.
    """
    keys = keys or ["raster_id", "row", "col"]
    own = [c for c in geom.AFFINE if c in windows.columns]
    size = tiles.where("band <= 3").groupBy("raster_id").agg(F.max("tile_w").alias("tw"), F.max("tile_h").alias("th"), F.collect_set("band").alias("bands"))
    every = windows.select(*keys, "x0", "y0", "x1", "y1", *own).where("x1 > x0 and y1 > y0").join(size, "raster_id", "left")
    rows = every.select(*keys, "x0", "y0", "x1", "y1", "tw", "th").where("tw is not null")
    lo, hi = (lambda c, t: F.floor(F.col(c) / F.col(t)).cast("int")), (lambda c, t: F.floor((F.col(c) - 1) / F.col(t)).cast("int"))
    rows = rows.withColumn("tile_col", F.explode(F.sequence(lo("x0", "tw"), hi("x1", "tw")))).withColumn("tile_row", F.explode(F.sequence(lo("y0", "th"), hi("y1", "th"))))
    some = tiles.where("band <= 3").select("raster_id", "tile_row", "tile_col", "tile_w", "tile_h", "band", "pixels")
    hit = rows.join(some, ["raster_id", "tile_row", "tile_col"])
    left, top = F.col("tile_col") * F.col("tw"), F.col("tile_row") * F.col("th")
    hit = hit.withColumns({"cx0": F.greatest("x0", left), "cx1": F.least(F.col("x1"), left + F.col("tile_w")), "cy0": F.greatest("y0", top), "cy1": F.least(F.col("y1"), top + F.col("tile_h"))})
    # Tiles go to their windows whole and once: what follows is grouped by the keys, in place. Work follows pixels and not bytes, so partitions stay as many.
    parts = max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    hit = hit.where("cx1 > cx0 and cy1 > cy0").repartition(parts, *keys).withColumn("y", F.explode(F.sequence("cy0", F.col("cy1") - 1)))
    part = F.slice("pixels", ((F.col("y") - top) * F.col("tile_w") + F.col("cx0") - left + 1).cast("int"), (F.col("cx1") - F.col("cx0")).cast("int"))
    hit = hit.select(*keys, "band", "x0", "y0", "x1", "y1", "y", "cx0", "cx1", part.alias("part"))
    # One line of a window from its tiles, left to right, with zeros between and around them.
    line = hit.groupBy(*keys, "band", "x0", "y0", "x1", "y1", "y").agg(F.array_sort(F.collect_list(F.struct("cx0", "cx1", "part"))).alias("parts"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    state = F.aggregate(
        "parts",
        F.struct(F.col("x0").alias("at"), F.array().cast("array<double>").alias("v")),
        lambda s, p: F.struct(p["cx1"].alias("at"), F.concat(s["v"], zeros(p["cx0"] - s["at"]), p["part"]).alias("v")),
    )
    line = line.withColumn("s", state).withColumn("line", F.concat(F.col("s.v"), zeros(F.col("x1") - F.col("s.at"))))
    whole = line.groupBy(*keys).agg(F.collect_list(F.struct("band", "y", "line")).alias("found"))
    every = every.join(whole, keys, "left")
    every = every.withColumn("band", F.explode(F.coalesce("bands", F.array(F.lit(1))))).drop("tw", "th", "bands")
    own_band = F.filter("found", lambda r: r["band"] == F.col("band"))
    lines = F.map_from_entries(F.transform(own_band, lambda r: F.struct(r["y"], r["line"])))
    every = every.withColumn("lines", lines).drop("found")
    empty = zeros(F.col("x1") - F.col("x0"))
    pixels = F.flatten(F.transform(F.sequence("y0", F.col("y1") - 1), lambda y: F.coalesce(F.try_element_at("lines", y), empty)))
    moved = {}
    if len(own) == len(geom.AFFINE):
        moved = dict(zip(("c", "f"), geom.pixel_to_geo(F.col("x0"), F.col("y0")), strict=True))
    return every.select(*keys, "band", "x0", "y0", "x1", "y1", *[moved.get(c, F.col(c)).alias(c) for c in own], pixels.alias("pixels"))


def bounds_windows(patches: DataFrame, rasters: DataFrame) -> DataFrame:
    """Pixel windows x0..y1 of geo bounds (raster_id, .., left, bottom, right, top); offsets and lengths are rounded, empty windows go."""
    rows = patches.join(rasters.select("raster_id", *geom.AFFINE), "raster_id")
    (c0, r0), (c1, r1) = geom.geo_to_pixel(F.col("left"), F.col("top")), geom.geo_to_pixel(F.col("right"), F.col("bottom"))
    whole = lambda v: F.round(v).cast("int")
    rows = rows.withColumns({"x0": whole(F.least(c0, c1)), "y0": whole(F.least(r0, r1)), "x1": whole(F.abs(c1 - c0)), "y1": whole(F.abs(r1 - r0))})
    return rows.where("x1 > 0 and y1 > 0").withColumns({"x1": F.col("x0") + F.col("x1"), "y1": F.col("y0") + F.col("y1")})


def crop_pixels(tiles: DataFrame, patches: DataFrame, rasters: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels 0..255 of patches given by geo bounds, with each patch's own affine; keys (with raster_id) name a patch."""
    return normalize_images(read_windows(tiles, bounds_windows(patches, rasters), keys), keys)


def detect_patches(tiles: DataFrame, centers: DataFrame, rasters: DataFrame, size: int, predictor_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A user's predictor on the square of so many pixels (clamped) around each geo centre (raster_id, center_id, x, y)."""
    keys = ["raster_id", "center_id"]
    return detect(normalize_images(read_windows(tiles, geo_windows(centers, rasters, size), keys), keys), predictor_factory, schema)


def three_bands(windows: DataFrame) -> DataFrame:
    """Images of one band (without a column band, as 2-D arrays are) as three equal bands; more than three are cut to the first three."""
    if "band" in windows.columns:
        return windows.where("band <= 3")
    return windows.withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(3))))


def geo_windows(centers: DataFrame, rasters: DataFrame, size: int = 640) -> DataFrame:
    """Pixel windows x0..y1 of a square of so many pixels (clamped) around geo centres (raster_id, center_id, x, y); may reach over the raster."""
    n = geom.clamp_size(F.lit(size))
    rows = centers.join(rasters, "raster_id")
    col, row = geom.geo_to_pixel(F.col("x"), F.col("y"))
    x0, y0 = F.round(col - n / 2).cast("int"), F.round(row - n / 2).cast("int")
    return rows.withColumns({"x0": x0, "y0": y0}).withColumns({"x1": F.col("x0") + n, "y1": F.col("y0") + n}).where("x0 is not null and y0 is not null")


def normalize_images(windows: DataFrame, keys: list[str] | None = None, is_uint8: Column | None = None) -> DataFrame:
    """pixels as whole numbers 0..255: trunc(v / max * 255) by the greatest value over a window's bands; 0 where that is not positive."""
    keys = keys or ["raster_id", "row", "col"]
    # Over the rows themselves, as windows from read_windows() stand by their keys already and are not read twice.
    rows = windows.dropna(subset=keys).withColumn("_top", F.max(F.array_max("pixels")).over(W.partitionBy(*keys)))
    scaled = F.transform("pixels", lambda v: F.when(F.col("_top") > 0, (v / F.col("_top") * 255).cast("int")).otherwise(0))
    plain = F.transform("pixels", lambda v: v.cast("int"))
    return rows.withColumn("pixels", scaled if is_uint8 is None else F.when(is_uint8, plain).otherwise(scaled)).drop("_top")


def detect(windows: DataFrame, predictor_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Runs a user's predictor over batches of windows; the factory is called once for each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = predictor_factory()
        for batch in batches:
            yield predict(batch)

    return windows.mapInPandas(run, schema)


def slice_results(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Detections (raster_id, row, col, idx, polygon in window pixels, score) with boxes and polygons in pixels and geo coordinates.

    Polygons with fewer than three vertices go; box, score and polygon stay on one row. A null score is 1.0.
    """
    rows = found.where(F.size("polygon") >= 3).join(window_edges(windows), ["raster_id", "row", "col"])
    box = geom.polygon_box(F.col("polygon"))
    rows = rows.withColumns(dict(zip(("px0", "py0", "px1", "py1"), box, strict=True)))
    x, y = F.col("x0"), F.col("y0")
    g = geom.boxes_pixel_to_geo(F.col("px0") + x, F.col("py0") + y, F.col("px1") + x, F.col("py1") + y)
    moved = F.transform("polygon", lambda v: geom.point(v["x"] + x, v["y"] + y))
    rows = rows.withColumns({"score": F.coalesce("score", F.lit(1.0)), "polygon": geom.polygon_pixel_to_geo(moved), **dict(zip(("gx0", "gy0", "gx1", "gy1"), g, strict=True))})
    columns = ["raster_id", "row", "col", "idx", "px0", "py0", "px1", "py1", "gx0", "gy0", "gx1", "gy1", "score", "polygon", "slice_w", "slice_h", "edge"]
    return rows.select(*columns)


def crop_windows(points: DataFrame, rasters_by_date: DataFrame, size: float, in_pixels: bool = False, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Time-series crops: for each point and each dated raster of its key the geo bounds of a square of size metres or pixels.

    With digits, bounds are rounded. Squares in metres are the same on every raster, so they are found before points meet rasters; a key's points are
    dealt to shares, so keys with many points and rasters are many tasks.
    """
    by, names = by or ["field_id"], ("left", "bottom", "right", "top")
    spots = points.select(*by, "fid", "x", "y")
    box = geom.pixel_square_from_geo if in_pixels else geom.square_around
    bounds = box(F.col("x"), F.col("y"), F.lit(float(size)))
    found = {n: c if digits is None else F.round(c, digits) + F.lit(0.0) for n, c in zip(names, bounds, strict=True)}
    dated = rasters_by_date.drop(*names)
    rows = all_pairs(spots if in_pixels else spots.withColumns(found), dated, by, "fid", "raster_id", 32, 1)
    rows = rows.withColumns(found) if in_pixels else rows
    return rows.select(*by, "fid", "x", "y", *[c for c in dated.columns if c not in by], *names)


def crop_series(
    points: DataFrame, rasters_by_date: DataFrame, tiles: DataFrame, size: float, in_pixels: bool = False, by: list[str] | None = None
) -> DataFrame:
    """Pixels of the square around each point on each dated raster of its key: by.., fid, raster_id, other columns of the raster, x0.., a..f, pixels 0..255.

    Points meet the rasters of their key, bounds become windows of each raster, and all windows read the tiles in one pass; what no tile has is 0.
    rasters_by_date: by.., raster_id, a..f and further columns, such as a date. fid must be unique in its key; crops without area go.
    """
    by = by or ["field_id"]
    keys = [*by, "fid", "raster_id"]
    affine = rasters_by_date.select("raster_id", *geom.AFFINE).distinct()
    bounds = crop_windows(points, rasters_by_date, size, in_pixels, by).select(*keys, "left", "bottom", "right", "top")
    pixels = crop_pixels(tiles, bounds, affine, keys)
    more = [c for c in rasters_by_date.columns if c not in {*by, *geom.AFFINE, "raster_id", *pixels.columns}]
    return pixels.join(rasters_by_date.select(*by, "raster_id", *more), [*by, "raster_id"]) if more else pixels
