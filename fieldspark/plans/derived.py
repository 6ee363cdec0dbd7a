"""Field tables derived from the given ones, each as a DataFrame and as a SQL expression with the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geom

#: Direction of the ridges of fields 0 to 3.
TURNS = ((1.0, 0.0), (0.6, 0.8), (0.8, -0.6), (0.0, 1.0))

DIRECTIONS_SQL = "SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.6, 0.8), (2, 0.8, -0.6), (3, 0.0, 1.0)) AS t(field_id, ux, uy)"

POINTS_SQL = f"""
  SELECT field_id, fid, l * ux - m * uy AS x, l * uy + m * ux AS y FROM (
    SELECT (o_custkey % 4)::BIGINT AS field_id, o_orderkey::BIGINT AS fid, o_totalprice::DOUBLE / 1000 AS l,
           (4 * (o_orderkey % 12))::DOUBLE + ((o_custkey * 37) % 101 - 50)::DOUBLE / 100 AS m FROM orders) JOIN ({DIRECTIONS_SQL}) USING (field_id)"""

SCATTER_SQL = """
  SELECT label::BIGINT AS field_id, vec_id::BIGINT AS fid, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings"""

RASTERS_SQL = """
  SELECT s_suppkey::BIGINT AS raster_id, (500 + 37 * (s_suppkey % 20))::INT AS width, (400 + 29 * (s_suppkey % 17))::INT AS height,
         0.1::DOUBLE AS a, 0::DOUBLE AS b, (100 + s_suppkey)::DOUBLE AS c, 0::DOUBLE AS d, (-0.1)::DOUBLE AS e, 200::DOUBLE AS f FROM supplier"""

DETECTIONS_SQL = """
  SELECT label::BIGINT AS raster_id, (vec_id % 3)::INT AS row, (vec_id % 2)::INT AS col, vec_id::BIGINT AS idx,
         round(embedding[1]::DOUBLE * 100, 3) AS gx0, round(embedding[2]::DOUBLE * 100, 3) AS gy0,
         round(embedding[1]::DOUBLE * 100, 3) + 4 + label AS gx1, round(embedding[2]::DOUBLE * 100, 3) + 4 + label AS gy1,
         round(abs(embedding[3]::DOUBLE), 4) AS score FROM embeddings"""

# Corner k of the rectangle of nation n: the centre, plus or minus half the sides, turned by seven degrees for each n.
BOUNDARIES_SQL = """
  SELECT (n_nationkey % 4)::BIGINT AS field_id, n_nationkey::BIGINT AS part_id, k,
         60 * (n_nationkey % 5) + 60 + sx * (40 + 3 * n_nationkey) * cos(radians(7 * n_nationkey)) - sy * (15 + n_nationkey % 7) * sin(radians(7 * n_nationkey)) AS x,
         22 + sx * (40 + 3 * n_nationkey) * sin(radians(7 * n_nationkey)) + sy * (15 + n_nationkey % 7) * cos(radians(7 * n_nationkey)) AS y
  FROM nation, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) AS corner(k, sx, sy)"""

EDITS_SQL = """
  SELECT user_id::BIGINT AS field_id, event_id::BIGINT AS seq, ts,
         CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'move' WHEN 'error' THEN 'delete' ELSE 'undo' END AS action,
         event_id % 8 AS fid, value::DOUBLE AS x, (event_id % 100)::DOUBLE AS y FROM events"""

PATHS_SQL = """
  SELECT page_id::BIGINT AS page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages"""

TILES_SQL = """
  SELECT label::BIGINT AS raster_id, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 8)::INT AS tile_row,
         ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 8)::INT AS tile_col, embedding FROM embeddings"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turn(at: int) -> Column:
    return F.element_at(F.array(*[F.lit(t[at]) for t in TURNS]), (F.col("field_id") + 1).cast("int"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants on twelve planted ridges for each of four fields, along the field's direction."""
    across = (4 * (F.col("o_orderkey") % 12)).cast("double") + ((F.col("o_custkey") * 37) % 101 - 50).cast("double") / 100
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).cast("long").alias("field_id"), F.col("o_orderkey").cast("long").alias("fid"), (F.col("o_totalprice").cast("double") / 1000).alias("l"), across.alias("m"))
    ux, uy = _turn(0), _turn(1)
    return rows.select("field_id", "fid", (F.col("l") * ux - F.col("m") * uy).alias("x"), (F.col("l") * uy + F.col("m") * ux).alias("y"))


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("field_id"), F.col("vec_id").cast("long").alias("fid"), (e[0].cast("double") * 100).alias("x"), (e[1].cast("double") * 100).alias("y"))


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of every field of points."""
    return points(spark, sf_dir).select("field_id").distinct().select("field_id", _turn(0).alias("ux"), _turn(1).alias("uy"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    affine = [F.lit(v).cast("double").alias(n) if v is not None else (100 + k).cast("double").alias(n) for n, v in zip("abcdef", (0.1, 0, None, 0, -0.1, 200), strict=True)]
    return _table(spark, sf_dir, "supplier").select(k.cast("long").alias("raster_id"), (500 + 37 * (k % 20)).cast("int").alias("width"), (400 + 29 * (k % 17)).cast("int").alias("height"), *affine)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("embedding"), F.col("vec_id")
    x, y = F.round(e[0].cast("double") * 100, 3), F.round(e[1].cast("double") * 100, 3)
    side = F.col("label") + 4
    return _table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("raster_id"), (k % 3).cast("int").alias("row"), (k % 2).cast("int").alias("col"), k.cast("long").alias("idx"),
        x.alias("gx0"), y.alias("gy0"), (x + side).alias("gx1"), (y + side).alias("gy1"), F.round(F.abs(e[2].cast("double")), 4).alias("score"),
    )


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    turn = F.radians((7 * n).cast("double"))
    corners = []
    for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        x = 60 * (n % 5) + 60 + sx * (40 + 3 * n) * F.cos(turn) - sy * (15 + n % 7) * F.sin(turn)
        y = 22 + sx * (40 + 3 * n) * F.sin(turn) + sy * (15 + n % 7) * F.cos(turn)
        corners.append(geom.point(x, y))
    return _table(spark, sf_dir, "nation").select((n % 4).cast("long").alias("field_id"), n.cast("long").alias("part_id"), F.array(F.array(*corners)).alias("rings"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind.isin("signup", "purchase"), "add").when(kind == "view", "move").when(kind == "error", "delete").otherwise("undo")
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("field_id"), F.col("event_id").cast("long").alias("seq"), "ts", action.alias("action"), (F.col("event_id") % 8).cast("long").alias("fid"), F.col("value").cast("double").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return _table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), plain.alias("path"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is one tile of eight by eight pixels; eight tiles make a row of its raster."""
    nth = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return _table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("raster_id"), F.floor(nth / 8).cast("int").alias("tile_row"), (nth % 8).cast("int").alias("tile_col"),
        F.lit(8).alias("tile_w"), F.lit(8).alias("tile_h"), F.lit(1).alias("band"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"),
    )
