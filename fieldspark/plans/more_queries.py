"""Further queries, over validation, scalar geometry, sinks and the less usual modes of operators; registered with those of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import shared_folder
from ..functions import geom
from ..operators import labels, points as pt, polygons, rasters, ridges, suppress
from ..sources import tables, tile_store
from . import derived as d
from . import queries as base
from .queries import query, r6


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Validation and shaping.


@query(f"WITH p AS ({d.POINTS_SQL}) SELECT field_id, fid FROM p WHERE fid % 5 = 0")
def bundle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.points(spark, sf_dir)
    return pt.bundle_gaps(rows, rows.where("fid % 5 <> 0").select("field_id", "fid")).select("field_id", "fid")


@query(f"WITH p AS ({d.POINTS_SQL}) SELECT field_id, count(*) AS n, sum(fid)::BIGINT AS fids FROM p WHERE CASE field_id WHEN 2 THEN fid = 9 ELSE fid % 3 = 0 END GROUP BY field_id HAVING count(*) >= 2")
def effective_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field 2 has at most one effective point and goes."""
    rows = d.points(spark, sf_dir).withColumn("effective", F.when(F.col("field_id") == 2, F.col("fid") == 9).otherwise(F.col("fid") % 3 == 0))
    return pt.effective_points(rows).groupBy("field_id").agg(F.count("*").alias("n"), F.sum("fid").alias("fids"))


@query("SELECT c_custkey::BIGINT AS id, k AS nth, (c_custkey % 7 + k)::DOUBLE AS x, (k * c_acctbal::DOUBLE) AS y FROM customer, (SELECT unnest([0, 1, 2]) AS k) WHERE k < c_custkey % 4")
def flatten_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-points of none to three members; empty ones go."""
    k = F.col("c_custkey")
    many = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((k % 7 + i).cast("double").alias("x"), (i * F.col("c_acctbal").cast("double")).alias("y"), i.alias("i")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("long").alias("id"), F.filter(many, lambda v: v["i"] < k % 4).alias("points"))
    return pt.flatten_points(rows.withColumn("at", F.lit(0))).withColumn("nth", (F.col("x") - F.col("id") % 7).cast("int")).select("id", "nth", "x", "y")


_RINGS_SQL = """
  SELECT c_custkey::BIGINT AS id, part_id, j, (c_custkey % 11 + 3 * j)::DOUBLE AS x, (c_custkey % 13 + j * j)::DOUBLE AS y
  FROM customer, (SELECT unnest([0, 1, 2]) AS part_id), (SELECT unnest([0, 1, 2, 3, 4]) AS j) WHERE j < 2 + (c_custkey + part_id) % 4"""


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of two to five vertices for each customer."""
    k = F.col("c_custkey")

    def part(i: int):
        n = (2 + (k + i) % 4).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: geom.point(k % 11 + 3 * j, k % 13 + j * j))

    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("long").alias("id"), F.array(*[part(i) for i in range(3)]).alias("parts"))


@query(f"WITH r AS ({_RINGS_SQL}) SELECT id, part_id::INT AS part_id, j::INT AS at, x, y FROM r WHERE 2 + (id + part_id) % 4 >= 3")
def explode_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.explode_vertices(_rings(spark, sf_dir))


@query("SELECT c_custkey::BIGINT AS field_id, 1::BIGINT AS n, 'not a polygon' AS problem FROM customer WHERE c_custkey % 4 <> 1")
def mask_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only where every part has three vertices or more is a mask usable."""
    rows = _rings(spark, sf_dir).select(F.col("id").alias("field_id"), F.col("parts").alias("rings"))
    # Parts of customer k have 2 + (k + i) % 4 vertices for i in 0, 1, 2: all are 3 or more if none of them is 2.
    return pt.boundary_violations(rows)


@query(f"WITH r AS ({_RINGS_SQL}) SELECT id, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM r WHERE part_id = 0 GROUP BY id")
def first_part_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _rings(spark, sf_dir).select("id", geom.first_part(F.col("parts")).alias("ring"))
    box = [c.alias(n) for c, n in zip(geom.polygon_box(F.col("ring")), ("x0", "y0", "x1", "y1"), strict=True)]
    return part.select("id", F.size("ring").cast("long").alias("n"), *box)


@query(f"WITH p AS ({d.POINTS_SQL}) SELECT field_id, fid, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, row_number() OVER (PARTITION BY field_id ORDER BY fid) - 1 AS nth FROM p")
def points_by_fid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pt.sorted_by_fid(d.points(spark, sf_dir))
    return rows.select("field_id", "fid", r6("x").alias("x"), r6("y").alias("y"), "nth")


@query(base.ORACLE_SQL["effective_mask"])
def prepare_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.prepare_points(d.points(spark, sf_dir), d.boundaries(spark, sf_dir)).select("field_id", "fid", "effective")


# Scalar geometry under a turned affine: x = 5 + 0.3 col + 0.4 row, y = 90 + 0.4 col - 0.3 row.

_TURNED = dict(zip("abcdef", (0.3, 0.4, 5.0, 0.4, -0.3, 90.0), strict=True))


@query(
    f"""WITH p AS ({d.SCATTER_SQL}), q AS (SELECT *, (0.3 * (x - 5) + 0.4 * (y - 90)) / 0.25 AS col, (0.4 * (x - 5) - 0.3 * (y - 90)) / 0.25 AS row FROM p)
    SELECT field_id, fid, round(col, 6) + 0 AS col, round(row, 6) + 0 AS row, round(5 + 0.3 * x + 0.4 * y, 6) + 0 AS gx, round(90 + 0.4 * x - 0.3 * y, 6) + 0 AS gy,
    round(x - 70 * 0.5, 6) + 0 AS sx0, round(x + 35, 6) + 0 AS sx1, round(y - 5, 6) + 0 AS sy0, round(y + 5, 6) + 0 AS sy1,
    greatest(128, least(2048, fid * 10))::BIGINT AS size, round(-degrees(atan2(x, y)), 6) + 0 AS to_y, CASE WHEN x <= 0 THEN 1 ELSE greatest(1, ceil(x / 0.5)) END::BIGINT AS bins,
    CASE fid % 3 WHEN 0 THEN 'deg' WHEN 1 THEN 'm' ELSE 'unit' END AS unit FROM q"""
)
def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tuple(F.lit(v) for v in _TURNED.values())
    x, y = F.col("x"), F.col("y")
    col, row = geom.geo_to_pixel(x, y, t)
    gx, gy = geom.pixel_to_geo(x, y, t)
    square = geom.pixel_square_from_geo(x, y, F.lit(100.0), t)
    crs = F.when(F.col("fid") % 3 == 0, "epsg:4326").when(F.col("fid") % 3 == 1, "EPSG:3857").otherwise("EPSG:1")
    return d.scatter(spark, sf_dir).select(
        "field_id", "fid", r6(col).alias("col"), r6(row).alias("row"), r6(gx).alias("gx"), r6(gy).alias("gy"),
        *[r6(c).alias(n) for c, n in zip(square, ("sx0", "sy0", "sx1", "sy1"), strict=True)],
        geom.clamp_size(F.col("fid") * 10).cast("long").alias("size"), r6(geom.angle_to_y(x, y)).alias("to_y"),
        geom.metres_to_bins(x, F.lit(0.5)).alias("bins"), geom.unit_of_crs(crs).alias("unit"),
    )


@query(
    f"""WITH r AS ({_RINGS_SQL}), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r WHERE part_id = 0),
    e AS (SELECT id, j, x, y FROM c UNION ALL SELECT id, n, x, y FROM c WHERE j = 0)
    SELECT id, j::INT AS at, round(5 + 0.3 * x + 0.4 * y, 6) + 0 AS x, round(90 + 0.4 * x - 0.3 * y, 6) + 0 AS y FROM e"""
)
def closed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings closed, empty ones dropped, and mapped from pixels to geo coordinates."""
    t = tuple(F.lit(v) for v in _TURNED.values())
    rows = _rings(spark, sf_dir).select("id", geom.first_part(F.col("parts")).alias("polygon"))
    nothing = rows.limit(1).withColumn("polygon", F.slice("polygon", 1, 0))
    closed = tables.closed_polygons(rows.unionByName(nothing)).select("id", geom.polygon_pixel_to_geo(F.col("polygon"), t).alias("polygon"))
    return closed.select("id", F.posexplode("polygon").alias("at", "v")).select("id", "at", r6("v.x").alias("x"), r6("v.y").alias("y"))


# Sources and sinks: written to the shared folder and read again.


@query(f"WITH p AS ({d.POINTS_SQL}) SELECT field_id, fid, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, 'seed' AS source, round(fid / 7.0::DOUBLE, 6) AS conf FROM p")
def points_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.points(spark, sf_dir).withColumns({"source": F.lit("seed"), "conf": F.col("fid") / 7.0})
    path = _new_path(spark, "points")
    tables.write_points(rows, path)
    found = tables.read_points(spark, path)
    return found.select(F.col("field_id").cast("long").alias("field_id"), "fid", r6("x").alias("x"), r6("y").alias("y"), "source", "conf")


@query(f"WITH c AS ({d.BOUNDARIES_SQL}) SELECT part_id AS field_id, count(*)::INT AS n, 'EPSG:3857' AS crs FROM c GROUP BY part_id")
def boundaries_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "boundaries")
    d.boundaries(spark, sf_dir).withColumns({"field_id": F.col("part_id"), "crs": F.lit("EPSG:3857")}).write.json(path)
    found = tables.read_boundaries(spark, path, "json", single=True)
    return found.select("field_id", F.size(F.get("rings", 0)).alias("n"), "crs")


@query(
    f"""WITH RECURSIVE {base._MERGED}, f AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY rank) - 1 AS fid FROM two)
    SELECT raster_id, fid, gx0 AS xmin, gy0 AS ymin, gx1 AS xmax, gy1 AS ymax, score, 5 AS n, round(gx0 + gx1 + gx1 + gx0 + gx0, 4) + 0 AS sum_x, 'EPSG:3857' AS crs FROM f"""
)
def detections_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box table as it is read back, with the ring of each box."""
    merged = suppress.merge_detections(d.detections(spark, sf_dir), 0.3, 0.6)
    paths = tables.export_detections(merged, _new_path(spark, "export"), crs="EPSG:3857")
    rows = spark.read.parquet(paths["bbox"])
    total = F.aggregate("polygon", F.lit(0.0), lambda a, v: a + v["x"])
    return rows.select(F.col("raster_id").cast("long").alias("raster_id"), "fid", "xmin", "ymin", "xmax", "ymax", "score", F.size("polygon").alias("n"), (F.round(total, 4) + F.lit(0.0)).alias("sum_x"), "crs")


@query(f"WITH det AS ({d.DETECTIONS_SQL}), u AS (SELECT *, 0 AS run FROM det WHERE idx % 2 = 0 UNION ALL SELECT *, 1 FROM det WHERE idx % 3 = 0) SELECT raster_id, row, col, row_number() OVER (PARTITION BY raster_id ORDER BY run, row, col, idx) - 1 AS idx, score FROM u")
def runs_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, saved and loaded by name, as one table of detections."""
    found, path = d.detections(spark, sf_dir), _new_path(spark, "runs")
    tables.save_run(found.where("idx % 2 = 0"), path, "even")
    tables.save_run(found.where("idx % 3 = 0"), path, "third")
    both = tables.concat_runs(tables.load_run(spark, path, "even"), tables.load_run(spark, path, "third"))
    return both.select(F.col("raster_id").cast("long").alias("raster_id"), "row", "col", "idx", "score")


@query(
    f"""WITH det AS ({d.DETECTIONS_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY raster_id, row, col ORDER BY score DESC, idx) AS k FROM det)
    SELECT raster_id, row, col, k::INT AS k, idx, score, round((gx0 + gx1) * 0.5, 6) + 0 AS cx, round((gy0 + gy1) * 0.5, 6) + 0 AS cy FROM o"""
)
def slice_report_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of the slice report, best first."""
    found = d.detections(spark, sf_dir)
    return tables.report_boxes(found).select("raster_id", "row", "col", "k", "idx", "score", r6("cx").alias("cx"), r6("cy").alias("cy"))


# Detections with pixel boxes, edges, polygons and missing scores.

_SLICED_SQL = f"""
  SELECT raster_id, row, col, idx, gx0, gy0, gx1, gy1, CASE WHEN idx % 10 = 0 THEN 1.0 ELSE score END AS score,
  (idx % 60)::DOUBLE AS px0, (idx % 47)::DOUBLE AS py0, (idx % 60 + 5)::DOUBLE AS px1, (idx % 47 + 6)::DOUBLE AS py1, col = 0 AS at_left, idx % 4 = 0 AS has_polygon FROM ({d.DETECTIONS_SQL})"""
_BORDER = f"""det AS ({_SLICED_SQL}), kept AS (SELECT * FROM det WHERE (at_left OR px0 > 2) AND py0 > 2 AND px1 < 62 AND py1 < 48),
  rk AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY score DESC, row, col, idx) AS rank FROM kept)"""


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("idx")
    edge = F.struct((F.col("col") == 0).alias("left"), *[F.lit(False).alias(n) for n in ("top", "right", "bottom")])
    triangle = F.array(geom.point(F.col("gx0"), F.col("gy0")), geom.point(F.col("gx1"), F.col("gy0")), geom.point(F.col("gx1"), F.col("gy1")))
    pixels = {n: c.cast("double") for n, c in zip(("px0", "py0", "px1", "py1"), (i % 60, i % 47, i % 60 + 5, i % 47 + 6), strict=True)}
    rows = d.detections(spark, sf_dir).withColumns({**pixels, "edge": edge, "slice_w": F.lit(64), "slice_h": F.lit(50), "polygon": F.when(i % 4 == 0, triangle)})
    return rows.withColumn("score", F.when(i % 10 != 0, F.col("score")))


@query(
    f"""WITH RECURSIVE {_BORDER}, {base._suppressed('rk', 'one', 0.3, False)}, {base._suppressed('one', 'two', 0.6, True)}
    SELECT raster_id, row_number() OVER (PARTITION BY raster_id ORDER BY rank) - 1 AS fid, idx, score, CASE WHEN has_polygon THEN 4 ELSE 5 END AS n FROM two"""
)
def merge_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border filter, missing scores, and polygons where there are some: triangles closed to four vertices, else the ring of the box."""
    merged = suppress.merge_detections(_sliced(spark, sf_dir), 0.3, 0.6)
    frame = suppress.export_frames(merged)[2].select("raster_id", "fid", F.size("polygon").alias("n"))
    number = suppress.ranked(merged.select("raster_id", "row", "col", "idx", "score"), ["raster_id"]).select("raster_id", (F.col("rank") - 1).cast("long").alias("fid"), "idx", "score")
    return number.join(frame, ["raster_id", "fid"])


@query(
    f"""WITH {base._WINDOWS}, det AS (SELECT raster_id, row, col, row * 10 + col AS idx, (3 + row)::DOUBLE AS px0, (4 + col)::DOUBLE AS py0, (9 + row)::DOUBLE AS px1, (11 + col)::DOUBLE AS py1, x0, y0 FROM win WHERE (row + col) % 3 <> 0)
    SELECT raster_id, row, col, idx::BIGINT AS idx, px0, py0, px1, py1, round(100 + raster_id + 0.1 * (x0 + px0), 6) AS gx0, round(200 - 0.1 * (y0 + py1), 6) AS gy0, round(100 + raster_id + 0.1 * (x0 + px1), 6) AS gx1,
    round(200 - 0.1 * (y0 + py0), 6) AS gy1, 1.0::DOUBLE AS score, 3 AS n FROM det"""
)
def slice_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a window as triangles; where (row + col) % 3 = 0 they have two vertices and go."""
    w = rasters.slice_windows(d.rasters(spark, sf_dir), 256, 0.2)
    a, b = F.col("row"), F.col("col")
    triangle = F.array(geom.point(3 + a, 4 + b), geom.point(9 + a, 4 + b), geom.point(9 + a, 11 + b))
    polygon = F.when((a + b) % 3 == 0, F.slice(triangle, 1, 2)).otherwise(triangle)
    found = w.select("raster_id", "row", "col", (a * 10 + b).cast("long").alias("idx"), polygon.alias("polygon"), F.lit(None).cast("double").alias("score"))
    rows = rasters.slice_results(found, w)
    return rows.select("raster_id", "row", "col", "idx", "px0", "py0", "px1", "py1", *[r6(c).alias(c) for c in ("gx0", "gy0", "gx1", "gy1")], "score", F.size("polygon").alias("n"))


# Patches and crops with pixels. The raster of a label has square pixels of half a metre; tiles are eight pixels wide.

_PATCHED = f"""
  t AS ({d.TILES_SQL}), px AS (SELECT raster_id, tile_row * 8 + (i - 1) // 8 AS y, tile_col * 8 + (i - 1) % 8 AS x, embedding[i]::DOUBLE AS v FROM t, (SELECT unnest(generate_series(1, 64)) AS i)),
  win AS (SELECT label::BIGINT AS raster_id, vec_id::BIGINT AS fid, (vec_id % 90 - 20)::INT AS x0, (vec_id % 41 - 20)::INT AS y0 FROM embeddings)"""


def _tile_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    affine = [F.lit(v).alias(n) for n, v in zip("abcdef", (0.5, 0.0, 10.0, 0.0, -0.5, 90.0), strict=True)]
    return d.tiles(spark, sf_dir).select("raster_id").distinct().select("raster_id", *affine)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k = F.col("vec_id")
    return rows.select(F.col("label").cast("long").alias("raster_id"), k.cast("long").alias("fid"), (k % 90 - 20).cast("int").alias("col"), (k % 41 - 20).cast("int").alias("row"))


@query(
    f"""WITH {_PATCHED}, cell AS (SELECT *, x0 + dx AS x, y0 + dy AS y FROM win, (SELECT unnest(generate_series(0, 9)) AS dx), (SELECT unnest(generate_series(0, 5)) AS dy)),
    img AS (SELECT raster_id, fid, x0, y0, list(coalesce(v, 0) ORDER BY y, x) AS p FROM cell LEFT JOIN px USING (raster_id, x, y) GROUP BY ALL), s AS (SELECT *, list_max(p) AS top FROM img)
    SELECT raster_id, fid, x0, y0, 10 + 0.5 * x0::DOUBLE AS c, 90 - 0.5 * y0::DOUBLE AS f, len(p)::INT AS n, list_sum(list_transform(p, lambda v: CASE WHEN top > 0 THEN trunc(v / top * 255) ELSE 0 END))::BIGINT AS total FROM s"""
)
def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of 10 by 6 pixels by geo bounds, some of them partly or wholly off the tiles, with their own affine."""
    left, top = 10 + 0.5 * F.col("col"), 90 - 0.5 * F.col("row")
    sites = _sites(spark, sf_dir).select("raster_id", "fid", left.alias("left"), (top - 3).alias("bottom"), (left + 5).alias("right"), top.alias("top"))
    rows = rasters.crop_pixels(d.tiles(spark, sf_dir), sites, _tile_rasters(spark, sf_dir), ["raster_id", "fid"])
    return rows.select("raster_id", "fid", "x0", "y0", "c", "f", F.size("pixels").alias("n"), F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of two dates for each of five fields."""
    k = F.col("raster_id")
    return _tile_rasters(spark, sf_dir).withColumns({"field_id": k % 5, "date": F.when(k < 5, "2024-05-01").otherwise("2024-06-01")})


@query(
    f"""WITH {_PATCHED}, dated AS (SELECT DISTINCT raster_id, raster_id % 5 AS field_id, CASE WHEN raster_id < 5 THEN '2024-05-01' ELSE '2024-06-01' END AS date FROM px),
    w AS (SELECT win.raster_id % 5 AS field_id, fid, x0, y0, dated.raster_id, date FROM win JOIN dated ON dated.field_id = win.raster_id % 5),
    cell AS (SELECT *, x0 + dx AS x, y0 + dy AS y FROM w, (SELECT unnest(generate_series(0, 5)) AS dx), (SELECT unnest(generate_series(0, 5)) AS dy)),
    img AS (SELECT field_id, fid, raster_id, date, x0, y0, list(coalesce(v, 0) ORDER BY y, x) AS p FROM cell LEFT JOIN px USING (raster_id, x, y) GROUP BY ALL), s AS (SELECT *, list_max(p) AS top FROM img)
    SELECT field_id, fid, raster_id, date, x0, y0, len(p)::INT AS n, list_sum(list_transform(p, lambda v: CASE WHEN top > 0 THEN trunc(v / top * 255) ELSE 0 END))::BIGINT AS total FROM s"""
)
def crop_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three metres around every site on both dates of its field, from a tile store that the crops prune."""
    x, y = 10 + 0.5 * F.col("col") + 1.5, 90 - 0.5 * F.col("row") - 1.5
    points = _sites(spark, sf_dir).select((F.col("raster_id") % 5).alias("field_id"), "fid", x.alias("x"), y.alias("y"))
    dated = _dated(spark, sf_dir)
    path = tile_store.write_tiles(d.tiles(spark, sf_dir), _new_path(spark, "tiles"))
    bounds = rasters.crop_windows(points, dated, 3.0).select("field_id", "fid", "raster_id", "left", "bottom", "right", "top")
    tiles = tile_store.read_tiles(spark, path, rasters.bounds_windows(bounds, dated.select("raster_id", *"abcdef")))
    rows = rasters.crop_series(points, dated, tiles, 3.0)
    return rows.select("field_id", "fid", "raster_id", "date", "x0", "y0", F.size("pixels").alias("n"), F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


def bright_share():
    """A predictor for tests: how many pixels of a patch are over 100 of 255."""

    def predict(rows):
        return rows[["raster_id", "center_id"]].assign(n=[int((p > 100).sum()) for p in rows["pixels"]])

    return predict


@query(
    f"""WITH {_PATCHED}, hit AS (SELECT w.raster_id, w.fid, max(v) AS top, list(v) AS p FROM win w JOIN px ON px.raster_id = w.raster_id AND px.x BETWEEN x0 - 64 AND x0 + 63 AND px.y BETWEEN y0 - 64 AND y0 + 63 GROUP BY ALL)
    SELECT win.raster_id, win.fid AS center_id, coalesce(len(list_filter(p, lambda v: top > 0 AND trunc(v / top * 255) > 100)), 0)::BIGINT AS n FROM win LEFT JOIN hit ON hit.raster_id = win.raster_id AND hit.fid = win.fid"""
)
def patch_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection on a square of 128 pixels (clamped from 50) around picked places."""
    sites = _sites(spark, sf_dir).select("raster_id", F.col("fid").alias("center_id"), (10 + 0.5 * F.col("col")).alias("x"), (90 - 0.5 * F.col("row")).alias("y"))
    return rasters.detect_patches(d.tiles(spark, sf_dir), sites, _tile_rasters(spark, sf_dir), 50, bright_share, "raster_id long, center_id long, n long")


@query(f"WITH t AS ({d.TILES_SQL}) SELECT raster_id, tile_row, tile_col, band::INT AS band, round(list_sum(embedding::DOUBLE[]), 4) + 0 AS total FROM t, (SELECT unnest([1, 2, 3]) AS band)")
def three_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.three_bands(d.tiles(spark, sf_dir).drop("band"))
    return rows.select("raster_id", "tile_row", "tile_col", "band", (F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 4) + F.lit(0.0)).alias("total"))


@query(f"WITH t AS ({d.TILES_SQL}) SELECT raster_id, tile_row AS row, tile_col AS col, list_sum(list_transform(embedding, lambda v: trunc(abs(v::DOUBLE) * 1000)))::BIGINT AS total FROM t")
def image_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of whole numbers already stay as they are."""
    rows = d.tiles(spark, sf_dir).select("raster_id", F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), F.transform("pixels", lambda v: F.floor(F.abs(v) * 1000).cast("double")).alias("pixels"))
    rows = rasters.normalize_images(rows, is_uint8=F.lit(True))
    return rows.select("raster_id", "row", "col", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(
    f"""WITH {base._WINDOWS} SELECT raster_id, row, col FROM win
    WHERE 0.1 * x0 + 100 + raster_id >= 110 + raster_id AND 0.1 * x1 + 100 + raster_id <= 170 + raster_id AND 200 - 0.1 * y0 <= 195 AND 200 - 0.1 * y1 >= 150"""
)
def slice_grid_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = d.rasters(spark, sf_dir)
    ring = geom.box_ring(F.lit(10) + F.col("c"), F.lit(150.0), F.lit(70) + F.col("c"), F.lit(195.0))
    return rasters.slice_grid(r, r.select("raster_id", F.array(ring).alias("rings")), 256, 0.2, "inside").select("raster_id", "row", "col")


@query(f"WITH {base._WINDOWS} SELECT raster_id, row, col FROM win")
def slice_grid_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary of two vertices keeps every window."""
    r = d.rasters(spark, sf_dir)
    line = F.array(geom.point(F.col("c"), F.lit(160.0)), geom.point(F.col("c") + 5, F.lit(165.0)))
    return rasters.slice_grid(r, r.select("raster_id", F.array(line).alias("rings")), 256, 0.2).select("raster_id", "row", "col")


# Grids.


@query(
    """WITH b AS (SELECT n_nationkey::BIGINT AS part_id, 2.0 * (40 + 3 * n_nationkey) AS w, 2.0 * (15 + n_nationkey % 7) AS h FROM nation), n AS (SELECT *, floor((w + 1.25) / 8.25)::INT AS cols, floor((h + 0.75) / 6.75)::INT AS rows FROM b)
    SELECT part_id, row_number() OVER (PARTITION BY part_id ORDER BY row, col) AS id, row, col, 'S' || row_number() OVER (PARTITION BY part_id ORDER BY row, col) || '-x' AS label
    FROM n, (SELECT unnest(generate_series(0, 60))::INT AS row), (SELECT unnest(generate_series(0, 60))::INT AS col) WHERE row < rows AND col < cols"""
)
def subplots_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a given size, as many as fit, written and read again, numbered in sequence."""
    parts = d.boundaries(spark, sf_dir).drop("field_id").withColumnRenamed("part_id", "key").withColumn("part_id", F.lit(0))
    cells = polygons.subplots(parts, width=7.0, height=6.0, x_spacing=1.25, y_spacing=0.75, by=["key"])
    path = polygons.write_subplots(cells, _new_path(spark, "subplots"), by=["key"])
    found = spark.read.parquet(path).withColumn("part_id", F.col("key").cast("long"))
    return labels.subplot_labels(found, "sequential", prefix="S", suffix="-x", by=["part_id"]).select("part_id", "id", "row", "col", "label")


@query("SELECT 0::BIGINT AS part_id, 0::INT AS row FROM nation WHERE false")
def subplots_no_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of minus the width leaves no grid."""
    parts = d.boundaries(spark, sf_dir).drop("field_id").withColumnRenamed("part_id", "key").withColumn("part_id", F.lit(0))
    return polygons.subplots(parts, width=10.0, height=6.0, x_spacing=-10.0, by=["key"]).select(F.col("key").alias("part_id"), "row")


# A cell touches the half plane x <= 100 (a wide box) if its least corner reaches it.
@query(
    f"""WITH {base._GRID}, corners AS (SELECT part_id, row, col, x + a * cw * ux - b * ch * uy AS cx FROM cells JOIN g ON g.n = cells.part_id, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS corner(a, b))
    SELECT part_id, row_number() OVER (PARTITION BY part_id ORDER BY row, col) AS id, row, col FROM corners GROUP BY part_id, row, col HAVING min(cx) <= 100"""
)
def subplots_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that touch an area, numbered after the filter."""
    cells = base._cells(spark, sf_dir).drop("id")
    ring = geom.box_ring(F.lit(-1000.0), F.lit(-1000.0), F.lit(100.0), F.lit(1000.0))
    area = cells.select("part_id").distinct().select("part_id", F.array(ring).alias("rings"))
    kept = polygons.keep_cells(cells, area, "touch", by=["part_id"])
    return labels.subplot_labels(kept, "sequential", by=["part_id"]).select("part_id", F.col("label").cast("long").alias("id"), "row", "col")


# Ridges: guards, options and names.


@query(
    f"""WITH RECURSIVE {base._ASSIGNED} SELECT field_id, fid, CASE WHEN field_id = 3 OR fid % 5 = 0 THEN -1 ELSE ridge_id END AS ridge_id, field_id <> 3 AND fid % 5 <> 0 AND is_inlier AS is_inlier FROM ordered"""
)
def order_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field without a direction and points that are not effective get -1."""
    rows = d.points(spark, sf_dir).withColumn("effective", F.col("fid") % 5 != 0)
    found = ridges.order_points(rows, d.directions(spark, sf_dir).where("field_id <> 3"), base._peaks(spark, sf_dir), base.BUFFER)
    return found.select("field_id", "fid", "ridge_id", "is_inlier")


@query(f"WITH RECURSIVE {base._PEAKS} SELECT field_id, ridge_index, bin, peak_height FROM peaks WHERE field_id <> 3")
def detect_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks at least 0.8 metres apart, which are two bins; a field without a direction has none."""
    found = ridges.detect_ridges(d.points(spark, sf_dir), d.directions(spark, sf_dir).where("field_id <> 3"), base.WIDTH, height=base.HEIGHT, metres=0.8)
    return found["peaks"].select("field_id", "ridge_index", "bin", "peak_height")


@query(
    f"""WITH RECURSIVE {base._ASSIGNED}, w AS (SELECT o.field_id, o.fid, o.ridge_id, v.along FROM ordered o JOIN v USING (field_id, fid)),
    n AS (SELECT *, row_number() OVER (PARTITION BY field_id, ridge_id ORDER BY round(along, {base.ALONG}) DESC, fid) AS k, row_number() OVER (PARTITION BY field_id, ridge_id < 0 ORDER BY ridge_id, round(along, {base.ALONG}) DESC, fid) AS nth FROM w)
    SELECT field_id, fid, CASE WHEN ridge_id >= 0 THEN (nth + 4)::VARCHAR END AS numeric_id, CASE WHEN ridge_id >= 0 THEN 'row ' || (ridge_id + 5) || ' plant ' || (k + 4) END AS custom_id FROM n"""
)
def plant_ids_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers over the field and names by pattern, from the far end, counted from five."""
    rows = ridges.assign_ridges(base._values(spark, sf_dir), ridges.ridge_intervals(base._peaks(spark, sf_dir), base.BUFFER))
    one = labels.plant_ids(rows, "numeric", start=5, ascending=False, digits=base.ALONG).withColumnRenamed("plant_id", "numeric_id")
    two = labels.plant_ids(one, "custom", start=5, ascending=False, pattern="row {ridge} plant {plant}", digits=base.ALONG)
    return two.select("field_id", "fid", "numeric_id", F.col("plant_id").alias("custom_id"))


@query(
    f"""WITH p AS ({d.PATHS_SQL}), a AS (SELECT DISTINCT path AS name FROM p WHERE page_id % 2 = 0), b AS (SELECT DISTINCT path AS name FROM p WHERE page_id % 3 = 0)
    SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'old' WHEN a.name IS NULL THEN 'new' ELSE 'both' END AS side FROM a FULL JOIN b ON a.name = b.name"""
)
def compare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.paths(spark, sf_dir).withColumnRenamed("path", "name")
    return labels.compare_names(p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0"))
