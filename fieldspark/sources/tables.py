"""Reading and writing of point, boundary and detection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geom
from ..numbering import row_numbers
from ..operators import points as pt
from ..operators import suppress

VERTEX = "struct<x:double,y:double>"
BOUNDARIES = f"field_id long, part_id long, rings array<array<{VERTEX}>>, crs string"
FORMATS = ("parquet", "csv", "json", "orc")


def _read(spark: SparkSession, path: str, fmt: str, schema: str | T.StructType | None) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is not among {FORMATS}")
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def read_points(spark: SparkSession, source: str | DataFrame, fmt: str = "parquet", schema: str | T.StructType | None = None) -> DataFrame:
    """Points from a path, or a DataFrame as it is; TypeError for anything else. csv and json have the schema POINTS unless one is given."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        raise TypeError("source must be a path or a DataFrame")
    return _read(spark, source, fmt, schema or (pt.POINTS if fmt in ("csv", "json") else None))


def read_boundaries(spark: SparkSession, path: str, fmt: str = "parquet", single: bool = True) -> DataFrame:
    """Boundaries of a path; with single, ValueError unless each key has exactly one polygon."""
    return pt.check_boundaries(_read(spark, path, fmt, BOUNDARIES if fmt == "json" else None), single)


def write_points(points: DataFrame, path: str, fmt: str = "parquet", by: str = "field_id", mode: str = "errorifexists") -> None:
    """fid, source, conf (six places) and coordinates, partitioned by key; a crs column is kept."""
    rows = points
    for name, value in (("source", F.lit(None).cast("string")), ("conf", F.lit(None).cast("double"))):
        rows = rows if name in rows.columns else rows.withColumn(name, value)
    columns = [by, "fid", "x", "y", "source", F.round(F.col("conf").cast("double"), 6).alias("conf"), *(["crs"] if "crs" in rows.columns else [])]
    rows.select(*columns).write.mode(mode).partitionBy(by).format(fmt).option("header", True).save(path)


def box_polygons(boxes: DataFrame) -> DataFrame:
    """Boxes (xmin, ymin, xmax, ymax) with their closed ring as polygon."""
    return boxes.withColumn("polygon", geom.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


def closed_polygons(masks: DataFrame) -> DataFrame:
    """Masks without empty polygons, rings closed."""
    return masks.where(F.size("polygon") > 0).withColumn("polygon", geom.close_ring(F.col("polygon")))


def export_detections(merged: DataFrame, prefix: str, fmt: str = "parquet", source: str = "model", crs: str | None = None, by: list[str] | None = None) -> dict[str, str]:
    """Writes {prefix}_bbox, {prefix}_points and {prefix}_polygon; returns their paths. A crs goes into every row."""
    boxes, points, polygons = suppress.export_frames(merged, source, by)
    out = {}
    for name, rows in (("bbox", box_polygons(boxes)), ("points", points), ("polygon", closed_polygons(polygons))):
        rows = rows.withColumn("crs", F.lit(crs)) if crs else rows
        rows.write.partitionBy(*(by or ["raster_id"])).format(fmt).save(out.setdefault(name, f"{prefix}_{name}"))
    return out


def save_run(detections: DataFrame, path: str, run_id: str) -> None:
    """Detections of a run, nested columns and all, so that they can be merged again without inference."""
    detections.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", "raster_id").parquet(path)


def load_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def slice_report(detections: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window how many detections it has, and their least and greatest score; their boxes are rows of report_boxes()."""
    keys = ["raster_id", "row", "col"]
    got = detections.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    return windows.join(got, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def report_boxes(detections: DataFrame, best: int | None = None) -> DataFrame:
    """(raster_id, row, col, k, idx, score, gx0.., cx, cy): the boxes of each window with centres, best first from 1; with best only so many.

    Rows, not a list: a window may have any number of boxes. Null scores come last.
    """
    keys = ["raster_id", "row", "col"]
    rows = row_numbers(detections, [F.desc("score"), "idx", *suppress.BOX], "k", keys)
    cx, cy = geom.box_center(*[F.col(c) for c in suppress.BOX])
    rows = rows.select(*keys, "k", "idx", "score", *suppress.BOX, cx.alias("cx"), cy.alias("cy"))
    return rows if best is None else rows.where(F.col("k") <= best)


def concat_runs(*runs: DataFrame) -> DataFrame:
    """Detections of several runs as one table; idx is numbered anew in each raster by run, slice and old idx."""
    rows = None
    for nth, run in enumerate(runs):
        part = run.withColumn("_run", F.lit(nth))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no run is given")
    numbered = row_numbers(rows, ["_run", "row", "col", "idx"], "_idx", ["raster_id"], first=0)
    return numbered.withColumn("idx", F.col("_idx")).drop("_run", "_idx")


def detection_counts(detections: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., n): detections of each raster or run."""
    return detections.groupBy(*(by or ["raster_id"])).agg(F.count("*").alias("n"))
