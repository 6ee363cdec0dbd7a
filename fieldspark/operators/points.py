"""Validation and shaping of point and boundary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geom
from ..numbering import row_numbers
from . import polygons

BY = ["field_id"]


def normalize_points(points: DataFrame, order_by: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """by.., fid, other columns, x, y. If a key has any null fid (or there is no fid), it is numbered 0.. in order_by.

    An empty table stays empty. Rows are numbered in two levels, so a key of any size is no single task. Raises ValueError without x and y.
    """
    by = by or BY
    if not {"x", "y"} <= set(points.columns):
        raise ValueError("Point coordinates x and y are missing")
    rows = points if "fid" in points.columns else points.withColumn("fid", F.lit(None).cast("long"))
    missing = rows.groupBy(*by).agg(F.max(F.col("fid").isNull()).alias("_missing"))
    missing = missing.select(*[F.col(k).alias(f"_{k}") for k in by], "_missing")
    numbered = row_numbers(rows, order_by or ["x", "y"], "_nr", by, first=0)
    same = [numbered[k].eqNullSafe(missing[f"_{k}"]) for k in by]
    joined = numbered.join(missing, same)
    fid = F.when(F.col("_missing"), F.col("_nr")).otherwise(F.col("fid").cast("long"))
    extras = [c for c in rows.columns if c not in {*by, "fid", "x", "y"}]
    return joined.select(*by, fid.alias("fid"), *extras, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _polygon_like(rings: Column) -> Column:
    return F.coalesce(F.size(rings) > 0, F.lit(False)) & F.forall(rings, lambda r: F.size(r) >= 3)


def boundary_violations(boundaries: DataFrame, single: bool = False, by: list[str] | None = None) -> DataFrame:
    """(by.., n, problem): keys whose boundaries are not usable; with single, a key must have exactly one."""
    by = by or BY
    rows = boundaries.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~_polygon_like(F.col("rings")) | F.col("rings").isNull()).alias("bad"))
    problem = F.when(F.col("bad") > 0, "not a polygon")
    problem = problem.when(F.col("n") != 1, "not exactly one boundary") if single else problem
    return rows.withColumn("problem", problem).where("problem is not null").select(*by, "n", "problem")


def check_boundaries(boundaries: DataFrame, single: bool = False, by: list[str] | None = None) -> DataFrame:
    """boundaries as they are; raises ValueError if the table is empty or a key's boundaries are not usable."""
    if boundaries.isEmpty():
        raise ValueError("Boundary table is empty")
    first = boundary_violations(boundaries, single, by).first()
    if first:
        raise ValueError(f"Boundary is wrong: {first.asDict()}")
    return boundaries


def bundle_gaps(points: DataFrame, mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Points without a mask row; empty for a whole bundle."""
    return points.join(mask, [*(by or BY), "fid"], "left_anti")


def effective_points(points: DataFrame, least: int = 2, by: list[str] | None = None) -> DataFrame:
    """Effective points of keys that have at least so many."""
    by = by or BY
    rows = points.where("effective")
    return rows.join(rows.groupBy(*by).count().where(F.col("count") >= least).select(*by), by, "left_semi")


def flatten_points(df: DataFrame, column: str = "points") -> DataFrame:
    """One row for each vertex of an array<struct<x, y>> column; null and empty ones go."""
    return df.withColumn("_v", F.explode(column)).where("_v.x is not null and _v.y is not null").select(*[c for c in df.columns if c != column], "_v.x", "_v.y")


def explode_vertices(df: DataFrame, parts: str = "parts", least: int = 3) -> DataFrame:
    """(.., part_id, at, x, y) of parts with at least so many vertices (3 for polygons, 2 for lines)."""
    others = [c for c in df.columns if c != parts]
    rows = df.select(*others, F.posexplode(parts).alias("part_id", "_part")).where(F.size("_part") >= least)
    return rows.select(*others, "part_id", F.posexplode("_part").alias("at", "_v")).select(*others, "part_id", "at", "_v.x", "_v.y")


def bounds(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., left, bottom, right, top, n)."""
    by = by or BY
    return points.groupBy(*by).agg(F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top"), F.count("*").alias("n"))


def crs_of(df: DataFrame) -> str | None:
    """The one crs of a table; raises ValueError if there are several."""
    found = [r[0] for r in df.select("crs").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("a table must have one crs")
    return found[0] if found else None


def align_crs(boundaries: DataFrame, crs: str | None) -> DataFrame:
    """boundaries in the given crs; a missing crs on either side is an error."""
    own = crs_of(boundaries)
    if not own or not crs:
        raise ValueError("crs is missing")
    rings = F.transform("rings", lambda r: geom.reproject_polygon(r, own, crs))
    return boundaries if own == crs else boundaries.withColumns({"rings": rings, "crs": F.lit(crs)})


def prepare_points(points: DataFrame, boundaries: DataFrame | None = None, order_by: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Normalised points with effective; all are effective without boundaries. With crs columns the boundaries follow the points'."""
    rows = normalize_points(points, order_by, by)
    if boundaries is None:
        return rows.withColumn("effective", F.lit(True))
    if "crs" in rows.columns and "crs" in boundaries.columns:
        boundaries = align_crs(boundaries, crs_of(rows))
    return polygons.effective_mask(rows, boundaries, by)


POINTS = T.StructType([T.StructField("field_id", T.LongType()), T.StructField("fid", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("crs", T.StringType())])


def sorted_by_fid(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """points with nth: the place of each by fid in its key, from 0, ties by coordinates."""
    return row_numbers(points, ["fid", "x", "y"], "nth", by or BY, first=0)
