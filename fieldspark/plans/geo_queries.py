"""Queries over map projections and large boundaries; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..functions import projections as pj
from ..operators import points as pt
from . import derived as d
from .queries import query

# Map projections. The SQL writes the same series out.


def _forward_sql(rows: str, t: pj.TransverseMercator) -> str:
    """rows (.., lon, lat) with x and y."""
    e = t.eccentricity
    alpha = list(enumerate(pj.terms(pj.ALPHA, t.third_flattening), 1))
    east = " + ".join(f"({a!r}) * cos({2 * j} * north) * sinh({2 * j} * east)" for j, a in alpha)
    north = " + ".join(f"({a!r}) * sin({2 * j} * north) * cosh({2 * j} * east)" for j, a in alpha)
    return f"""
      SELECT * EXCLUDE (t, turn, north, east), {t.easting!r} + {t.radius!r} * (east + {east}) AS x, {t.northing!r} + {t.radius!r} * (north + {north}) AS y FROM (
        SELECT *, atan2(t, cos(turn)) AS north, asinh(sin(turn) / sqrt(t * t + cos(turn) * cos(turn))) AS east FROM (
          SELECT *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - ({t.central!r})) AS turn FROM ({rows})))"""


_LONLAT_SQL = f"""
  SELECT field_id, fid, (-75.0 + 60 * field_id + ((fid * 13) % 6001 - 3000)::DOUBLE / 1000)::DOUBLE AS lon, (((fid * 7) % 16001 - 8000)::DOUBLE / 100)::DOUBLE AS lat
  FROM ({d.POINTS_SQL})"""
#: A system for each of the four fields: both hemispheres of UTM, ETRS89 and CGCS2000.
_SYSTEMS = ("EPSG:32618", "EPSG:32728", "EPSG:4540", "EPSG:32648")
_CENTRAL = (-75.0, -15.0, 93.0, 105.0)


def _lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within three degrees of the central meridian of their field's system."""
    fid = F.col("fid")
    central = F.element_at(F.array(*[F.lit(c) for c in _CENTRAL]), (F.col("field_id") + 1).cast("int"))
    lon = central + ((fid * 13) % 6001 - 3000).cast("double") / 1000
    return d.points(spark, sf_dir).select("field_id", "fid", lon.alias("lon"), (((fid * 7) % 16001 - 8000).cast("double") / 100).alias("lat"))


_LONLAT_SQL = _LONLAT_SQL.replace("-75.0 + 60 * field_id", f"{list(_CENTRAL)!r}[field_id + 1]")
_UTM_SQL = " UNION ALL ".join(
    f"SELECT field_id, fid, round(x, 3) + 0 AS x, round(y, 3) + 0 AS y, round(lon, 7) + 0 AS lon, round(lat, 7) + 0 AS lat FROM ({_forward_sql(f'SELECT * FROM ({_LONLAT_SQL}) WHERE field_id = {k}', pj.projection(code))})"
    for k, code in enumerate(_SYSTEMS)
)


@query(_UTM_SQL)
def points_reproject_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the system of their field, and back."""
    out = None
    for k, code in enumerate(_SYSTEMS):
        rows = _lonlat(spark, sf_dir).where(F.col("field_id") == k)
        x, y = pj.reproject(F.col("lon"), F.col("lat"), "EPSG:4326", code)
        rows = rows.select("field_id", "fid", x.alias("x"), y.alias("y"))
        lon, lat = pj.reproject(F.col("x"), F.col("y"), code, "EPSG:4326")
        rows = rows.select("field_id", "fid", *[(F.round(c, n) + F.lit(0.0)).alias(a) for c, n, a in ((F.col("x"), 3, "x"), (F.col("y"), 3, "y"), (lon, 7, "lon"), (lat, 7, "lat"))])
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""WITH p AS ({d.POINTS_SQL}), b AS ({d.BOUNDARIES_SQL}), e AS (
          SELECT field_id, part_id, x AS x1, y AS y1, lead(x, 1, first) OVER w AS x2, lead(y, 1, first_y) OVER w AS y2 FROM (
            SELECT *, first_value(x) OVER (PARTITION BY part_id ORDER BY k) AS first, first_value(y) OVER (PARTITION BY part_id ORDER BY k) AS first_y FROM b)
          WINDOW w AS (PARTITION BY part_id ORDER BY k)),
        hit AS (SELECT p.field_id, fid, part_id, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)) % 2 AS odd
                FROM p JOIN e USING (field_id) GROUP BY ALL)
        SELECT field_id, count(*) AS n, count(*) FILTER (WHERE covered) AS n_effective, sum(fid) FILTER (WHERE covered)::BIGINT AS fids
        FROM (SELECT field_id, fid, max(odd) = 1 AS covered FROM hit GROUP BY field_id, fid) GROUP BY field_id"""
)
def prepare_points_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a UTM zone and boundaries in degrees, which follow the points' system."""
    east, north, code = 500_000.0, 5_300_000.0, "EPSG:32633"
    points = d.points(spark, sf_dir).select("field_id", "fid", (F.col("x") + east).alias("x"), (F.col("y") + north).alias("y"), F.lit(code).alias("crs"))
    moved = F.transform("rings", lambda r: F.transform(r, lambda v: geom.point(v["x"] + east, v["y"] + north)))
    boundaries = d.boundaries(spark, sf_dir).withColumn("rings", moved)
    boundaries = boundaries.withColumns({"rings": F.transform("rings", lambda r: geom.reproject_polygon(r, code, "EPSG:4326")), "crs": F.lit("EPSG:4326")})
    rows = pt.prepare_points(points, boundaries)
    inside = F.when(F.col("effective"), F.col("fid"))
    return rows.groupBy("field_id").agg(F.count("*").alias("n"), F.count_if("effective").alias("n_effective"), F.sum(inside).alias("fids"))
