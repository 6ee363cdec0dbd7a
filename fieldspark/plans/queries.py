"""The library's own queries over tables derived from the given ones, and the same in DuckDB's SQL.

Computed doubles are rounded to six places on both sides; adding zero turns a negative zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import grids, labels, polygons, rasters, ridges, suppress
from ..operators import points as pt
from ..sources import tables
from ..streaming import edits as ed
from . import derived as d

Query = Callable[[SparkSession, str], DataFrame]
WIDTH, DISTANCE, HEIGHT, BUFFER = 0.5, 2, 6, 0.8
#: Digits of places along a ridge; what is less is rounding noise.
ALONG = 6


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Ridges.

_PROJECTED = f"""
  p AS ({d.POINTS_SQL}), o AS (SELECT field_id, avg(x) AS ox, avg(y) AS oy FROM p GROUP BY field_id),
  dir AS ({d.DIRECTIONS_SQL}), v AS (SELECT p.*, (x - ox) * ux + (y - oy) * uy AS along, (y - oy) * ux - (x - ox) * uy AS perp, ox, oy, ux, uy FROM p JOIN o USING (field_id) JOIN dir USING (field_id))"""
_DENSITY = f"""{_PROJECTED},
  c AS (SELECT field_id, floor(perp / {WIDTH})::BIGINT AS bin, count(*) AS n FROM v GROUP BY ALL),
  g AS (SELECT field_id, unnest(generate_series(min(bin), max(bin))) AS bin FROM c GROUP BY field_id),
  density AS (SELECT field_id, bin, bin * {WIDTH} AS x_bin, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c USING (field_id, bin))"""
_PEAKS = f"""{_DENSITY},
  steps AS (SELECT *, (n IS DISTINCT FROM lag(n) OVER (PARTITION BY field_id ORDER BY bin))::INT AS new FROM density),
  runs AS (SELECT field_id, run, min(bin) AS lo, max(bin) AS hi, min(n) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY field_id ORDER BY bin) AS run FROM steps) GROUP BY field_id, run),
  tops AS (SELECT field_id, floor((lo + hi) / 2)::BIGINT AS bin, n,
                  lag(n) OVER w AS before, lead(n) OVER w AS after FROM runs WINDOW w AS (PARTITION BY field_id ORDER BY run)),
  ranked AS (SELECT field_id, bin, n, row_number() OVER (PARTITION BY field_id ORDER BY n DESC, bin DESC) AS rank FROM tops WHERE n > before AND n > after AND n >= {HEIGHT}),
  greedy AS (
    SELECT field_id, 0::BIGINT AS rank, []::BIGINT[] AS kept FROM ranked GROUP BY field_id
    UNION ALL
    SELECT g.field_id, r.rank, CASE WHEN len(list_filter(g.kept, lambda b: abs(b - r.bin) < {DISTANCE})) = 0 THEN list_append(g.kept, r.bin) ELSE g.kept END
    FROM greedy g JOIN ranked r ON r.field_id = g.field_id AND r.rank = g.rank + 1),
  final AS (SELECT field_id, arg_max(kept, rank) AS kept FROM greedy GROUP BY field_id),
  peaks AS (SELECT k.field_id, row_number() OVER (PARTITION BY k.field_id ORDER BY k.bin) - 1 AS ridge_index, k.bin, k.bin * {WIDTH} AS peak_x, r.n AS peak_height
            FROM (SELECT field_id, unnest(kept) AS bin FROM final) k JOIN ranked r ON r.field_id = k.field_id AND r.bin = k.bin)"""
_INTERVALS = f"""{_PEAKS},
  sides AS (SELECT field_id, ridge_index AS ridge_id, peak_x, lag(peak_x) OVER w AS before, lead(peak_x) OVER w AS after FROM peaks WINDOW w AS (PARTITION BY field_id ORDER BY peak_x)),
  ends AS (SELECT field_id, ridge_id, coalesce((before + peak_x) / 2, peak_x - greatest({BUFFER}, coalesce((after - peak_x) / 2, {BUFFER}))) AS lo,
                  coalesce((peak_x + after) / 2, peak_x + greatest({BUFFER}, coalesce((peak_x - before) / 2, {BUFFER}))) AS hi FROM sides),
  intervals AS (SELECT *, (lo + hi) / 2 AS center FROM ends)"""
_ASSIGNED = f"""{_INTERVALS},
  hits AS (SELECT v.field_id, v.fid, arg_min(ridge_id, struct_pack(d := abs(center - perp), r := ridge_id)) AS ridge_id
           FROM v JOIN intervals i ON i.field_id = v.field_id AND perp BETWEEN lo AND hi GROUP BY v.field_id, v.fid),
  ordered AS (SELECT p.*, coalesce(ridge_id, -1) AS ridge_id, ridge_id IS NOT NULL AS is_inlier FROM p LEFT JOIN hits USING (field_id, fid))"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ridges.projected(d.points(spark, sf_dir), d.directions(spark, sf_dir))


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ridges.density_histogram(_values(spark, sf_dir), WIDTH)


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ridges.ridge_peaks(_density(spark, sf_dir), DISTANCE, HEIGHT)


@query(f"WITH {_DENSITY} SELECT * FROM density")
def density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _density(spark, sf_dir)


@query(f"WITH {_PROJECTED} SELECT field_id, fid, round(along, 6) + 0 AS along, round(perp, 6) + 0 AS perp FROM v")
def points_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_values(spark, sf_dir).select("field_id", "fid", "along", "perp"), "along", "perp")


@query(f"WITH p AS ({d.POINTS_SQL}) SELECT field_id, round(min(x), 6) + 0 AS \"left\", round(min(y), 6) + 0 AS bottom, round(max(x), 6) + 0 AS \"right\", round(max(y), 6) + 0 AS top, count(*) AS n FROM p GROUP BY field_id")
def points_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pt.bounds(d.points(spark, sf_dir)), "left", "bottom", "right", "top")


@query(
    f"""WITH p AS ({d.POINTS_SQL}), q AS (SELECT field_id, CASE WHEN field_id = 1 AND fid % 97 = 0 THEN NULL ELSE fid END AS fid, x, y, fid AS own FROM p)
    SELECT field_id, CASE WHEN bool_or(fid IS NULL) OVER (PARTITION BY field_id) THEN row_number() OVER (PARTITION BY field_id ORDER BY own) - 1 ELSE fid END AS fid, own, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM q"""
)
def points_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.points(spark, sf_dir).withColumn("own", F.col("fid"))
    rows = rows.withColumn("fid", F.when((F.col("field_id") == 1) & (F.col("fid") % 97 == 0), None).otherwise(F.col("fid")))
    return _rounded(pt.normalize_points(rows, ["own"]), "x", "y")


@query(f"WITH RECURSIVE {_PEAKS} SELECT * FROM peaks")
def ridge_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {_PEAKS}, e AS (SELECT field_id, min(along) AS lo, max(along) AS hi, min(ox) AS ox, min(oy) AS oy, min(ux) AS ux, min(uy) AS uy FROM v GROUP BY field_id)
    SELECT field_id, ridge_index, round(ox - uy * peak_x + ux * lo, 6) + 0 AS x0, round(oy + ux * peak_x + uy * lo, 6) + 0 AS y0, round(ox - uy * peak_x + ux * hi, 6) + 0 AS x1, round(oy + ux * peak_x + uy * hi, 6) + 0 AS y1 FROM peaks JOIN e USING (field_id)"""
)
def ridge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ridges.ridge_lines(_values(spark, sf_dir), _peaks(spark, sf_dir)), "x0", "y0", "x1", "y1")


@query(
    f"""WITH RECURSIVE {_PEAKS}, s AS (SELECT field_id, n AS v FROM density UNION ALL SELECT field_id, peak_height FROM peaks),
    e AS (SELECT field_id, least(min(v), {HEIGHT})::DOUBLE AS lo, greatest(max(v), {HEIGHT})::DOUBLE AS hi FROM s GROUP BY field_id)
    SELECT field_id, round(lo - CASE WHEN hi > lo THEN (hi - lo) * 0.05 ELSE 0.5 END, 6) AS y_min, round(hi + CASE WHEN hi > lo THEN (hi - lo) * 0.05 ELSE 0.5 END, 6) AS y_max FROM e"""
)
def profile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ridges.profile_range(_density(spark, sf_dir), _peaks(spark, sf_dir), HEIGHT), "y_min", "y_max")


@query(f"WITH RECURSIVE {_INTERVALS} SELECT * FROM intervals")
def ridge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ridges.ridge_intervals(_peaks(spark, sf_dir), BUFFER)


@query(f"WITH RECURSIVE {_ASSIGNED} SELECT field_id, fid, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, ridge_id, is_inlier FROM ordered")
def ridge_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ridges.order_points(d.points(spark, sf_dir), d.directions(spark, sf_dir), _peaks(spark, sf_dir), BUFFER), "x", "y")


@query(
    f"""WITH RECURSIVE {_ASSIGNED}, k AS (SELECT field_id, count(*) AS ridge_count FROM peaks GROUP BY field_id)
    SELECT field_id, count(*) AS total, count(*) AS effective, count(*) FILTER (ridge_id >= 0) AS assigned, count(*) FILTER (ridge_id < 0) AS ignored, any_value(ridge_count) AS ridge_count
    FROM ordered JOIN k USING (field_id) GROUP BY field_id"""
)
def ordering_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = _peaks(spark, sf_dir)
    ordered = ridges.order_points(d.points(spark, sf_dir), d.directions(spark, sf_dir), peaks, BUFFER)
    return ridges.ordering_stats(ordered, d.points(spark, sf_dir), peaks)


# The first 2000 pairs of a ridge in a fixed scrambled order (all, if there are no more); most points within 0.4037, then least squared error.
_FITTED = f"""{_ASSIGNED},
  r AS (SELECT o.field_id, o.fid, o.ridge_id, v.along, v.perp, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o.field_id, o.ridge_id) AS n
        FROM ordered o JOIN v USING (field_id, fid) WHERE o.ridge_id >= 0 WINDOW w AS (PARTITION BY o.field_id, o.ridge_id ORDER BY o.fid)),
  pairs AS (SELECT a.field_id, a.ridge_id, CASE WHEN a.along = b.along THEN 0 ELSE (b.perp - a.perp) / (b.along - a.along) END AS slope, a.along AS x0, a.perp AS y0, b.along AS x1, b.perp AS y1,
            row_number() OVER (PARTITION BY a.field_id, a.ridge_id ORDER BY CASE WHEN a.n * (a.n - 1) / 2 <= 2000 THEN 0 ELSE (a.i * 7919 + b.i * 104729) % 1000003 END, a.i, b.i) AS nr
            FROM r a JOIN r b ON a.field_id = b.field_id AND a.ridge_id = b.ridge_id AND a.i < b.i QUALIFY nr <= 2000),
  lines AS (SELECT *, CASE WHEN x0 = x1 THEN (y0 + y1) / 2 ELSE y0 - slope * x0 END AS shift FROM pairs),
  fits AS (SELECT l.field_id, l.ridge_id, l.nr, count(*) FILTER (abs(perp - slope * along - shift) <= 0.4037) AS c, coalesce(sum((perp - slope * along - shift) ** 2) FILTER (abs(perp - slope * along - shift) <= 0.4037), 0) AS sq
           FROM lines l JOIN r ON r.field_id = l.field_id AND r.ridge_id = l.ridge_id GROUP BY ALL),
  best AS (SELECT field_id, ridge_id, arg_min(nr, struct_pack(c := -c, sq := sq, nr := nr)) AS nr FROM fits GROUP BY ALL),
  flags AS (SELECT r.field_id, r.fid, abs(perp - slope * along - shift) <= 0.4037 AS good FROM r JOIN best USING (field_id, ridge_id) JOIN lines l ON l.field_id = r.field_id AND l.ridge_id = r.ridge_id AND l.nr = best.nr)"""


@query(f"WITH RECURSIVE {_FITTED} SELECT field_id, fid, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, ridge_id, coalesce(good, is_inlier) AS is_inlier FROM ordered LEFT JOIN flags USING (field_id, fid)")
def ransac_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ridges.order_points(d.points(spark, sf_dir), d.directions(spark, sf_dir), _peaks(spark, sf_dir), BUFFER, residual=0.4037), "x", "y")


@query(
    f"""WITH RECURSIVE {_ASSIGNED}, w AS (SELECT o.field_id, o.fid, o.ridge_id, v.along FROM ordered o JOIN v USING (field_id, fid))
    SELECT field_id, fid, ridge_id, CASE WHEN ridge_id >= 0 THEN (ridge_id + 1) || '-' || row_number() OVER (PARTITION BY field_id, ridge_id ORDER BY round(along, {ALONG}), fid) END AS plant_id FROM w"""
)
def plant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    rows = ridges.assign_ridges(values, ridges.ridge_intervals(_peaks(spark, sf_dir), BUFFER))
    return labels.plant_ids(rows, digits=ALONG).select("field_id", "fid", "ridge_id", "plant_id")


# Detections.

_RANKED = f"""
  det AS ({d.DETECTIONS_SQL}), rk AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY score DESC, row, col, idx) AS rank FROM det)"""


def _suppressed(source: str, name: str, limit: float, ios: bool) -> str:
    """A recursive walk down the ranks of source, with the list of kept boxes so far; the rows of name are kept."""
    inter = "greatest(least(b.x1, r.gx1) - greatest(b.x0, r.gx0), 0) * greatest(least(b.y1, r.gy1) - greatest(b.y0, r.gy0), 0)"
    area_b, area_r = "(b.x1 - b.x0) * (b.y1 - b.y0)", "(r.gx1 - r.gx0) * (r.gy1 - r.gy0)"
    base = f"least({area_b}, {area_r})" if ios else f"{area_b} + {area_r} - {inter}"
    box = "struct_pack(nr := r.nr, x0 := r.gx0, y0 := r.gy0, x1 := r.gx1, y1 := r.gy1)"
    return f"""
  {name}_in AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY rank) AS nr FROM {source}),
  {name}_walk AS (
    SELECT raster_id, 0::BIGINT AS nr, []::STRUCT(nr BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept FROM {name}_in GROUP BY raster_id
    UNION ALL
    SELECT g.raster_id, r.nr, CASE WHEN len(list_filter(g.kept, lambda b: {inter} / greatest({base}, 1e-9) > {limit})) = 0 THEN list_append(g.kept, {box}) ELSE g.kept END
    FROM {name}_walk g JOIN {name}_in r ON r.raster_id = g.raster_id AND r.nr = g.nr + 1),
  {name}_end AS (SELECT raster_id, arg_max(kept, nr) AS kept FROM {name}_walk GROUP BY raster_id),
  {name} AS (SELECT i.* EXCLUDE (nr) FROM {name}_in i JOIN (SELECT raster_id, unnest(kept).nr AS nr FROM {name}_end) k ON k.raster_id = i.raster_id AND k.nr = i.nr)"""


_NMS = f"{_RANKED}, {_suppressed('rk', 'one', 0.1, False)}"
_MERGED = f"{_RANKED}, {_suppressed('rk', 'one', 0.3, False)}, {_suppressed('one', 'two', 0.6, True)}"


@query(f"WITH RECURSIVE {_NMS} SELECT raster_id, idx, score, rank FROM one")
def nms_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.nms(d.detections(spark, sf_dir), 0.1).select("raster_id", "idx", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH RECURSIVE {_MERGED} SELECT raster_id, idx, score, rank FROM two")
def nms_ios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.nms(d.detections(spark, sf_dir), 0.3, 0.6).select("raster_id", "idx", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH RECURSIVE {_MERGED} SELECT raster_id, row_number() OVER (PARTITION BY raster_id ORDER BY rank) - 1 AS fid, round((gx0 + gx1) * 0.5, 6) + 0 AS x, round((gy0 + gy1) * 0.5, 6) + 0 AS y,
    'model' AS source, score AS conf FROM two"""
)
def merge_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = suppress.merge_detections(d.detections(spark, sf_dir), 0.3, 0.6)
    return _rounded(suppress.export_frames(merged)[1], "x", "y")


@query(
    f"""WITH det AS ({d.DETECTIONS_SQL}), w AS (SELECT DISTINCT l.raster_id, row, col FROM (SELECT DISTINCT raster_id FROM det) l, (SELECT unnest([0, 1, 2]) AS row), (SELECT unnest([0, 1, 2]) AS col))
    SELECT w.raster_id, w.row, w.col, count(idx) AS n, min(score) AS min_score, max(score) AS max_score FROM w LEFT JOIN det USING (raster_id, row, col) GROUP BY ALL"""
)
def slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.detections(spark, sf_dir)
    nine = F.sequence(F.lit(0), F.lit(2))
    windows = found.select("raster_id").distinct().withColumn("row", F.explode(nine)).withColumn("col", F.explode(nine))
    return tables.slice_report(found, windows).drop("boxes")


@query(f"WITH det AS ({d.DETECTIONS_SQL}) SELECT raster_id, count(*) AS n FROM det GROUP BY raster_id")
def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.detection_counts(d.detections(spark, sf_dir))


# Boundaries and grids.

_EDGES = f"""
  c AS ({d.BOUNDARIES_SQL}), e AS (SELECT a.field_id, a.part_id, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM c a JOIN c b ON a.part_id = b.part_id AND b.k = (a.k + 1) % 4)"""


@query(
    f"""WITH {_EDGES}, p AS ({d.POINTS_SQL}),
    n AS (SELECT p.field_id, p.fid, e.part_id, count(*) FILTER ((py > y) <> (qy > y) AND x < px + (y - py) * (qx - px) / (qy - py)) % 2 = 1 AS inside FROM p JOIN e USING (field_id) GROUP BY ALL)
    SELECT field_id, fid, bool_or(inside) AS effective FROM n GROUP BY field_id, fid"""
)
def effective_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.effective_mask(d.points(spark, sf_dir), d.boundaries(spark, sf_dir)).select("field_id", "fid", "effective")


@query(
    """SELECT n_nationkey::BIGINT AS part_id, round(cos(radians(7 * n_nationkey)) * s, 6) + 0 AS xx, round(sin(radians(7 * n_nationkey)) * s, 6) + 0 AS xy,
    round(-sin(radians(7 * n_nationkey)) * s, 6) + 0 AS yx, round(cos(radians(7 * n_nationkey)) * s, 6) + 0 AS yy FROM (SELECT *, CASE WHEN cos(radians(7 * n_nationkey)) < 0 THEN -1 ELSE 1 END AS s FROM nation)"""
)
def boundary_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = d.boundaries(spark, sf_dir).drop("field_id").withColumnRenamed("part_id", "key").withColumn("part_id", F.lit(0))
    return _rounded(polygons.boundary_axes(parts, ["key"]).withColumnRenamed("key", "part_id"), "xx", "xy", "yx", "yy")


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS part_id, radians(7 * n_nationkey) AS t, CASE WHEN cos(radians(7 * n_nationkey)) < 0 THEN -1 ELSE 1 END AS s, n_nationkey % 5 AS how FROM nation)
    SELECT part_id, round(CASE how WHEN 0 THEN s * cos(t) WHEN 1 THEN -s * sin(t) WHEN 2 THEN -s * cos(t) WHEN 3 THEN s * sin(t) ELSE 0.6 END, 6) + 0 AS ux,
    round(CASE how WHEN 0 THEN s * sin(t) WHEN 1 THEN s * cos(t) WHEN 2 THEN -s * sin(t) WHEN 3 THEN -s * cos(t) ELSE 0.8 END, 6) + 0 AS uy FROM n"""
)
def resolve_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = d.boundaries(spark, sf_dir).drop("field_id").withColumnRenamed("part_id", "key").withColumn("part_id", F.lit(0))
    how = F.element_at(F.array(*[F.lit(x) for x in ("boundary_x", "boundary_y", "boundary_-x", "boundary_-y", "manual_draw")]), (F.col("key") % 5 + 1).cast("int"))
    drawn = {n: F.lit(float(v)) for n, v in zip(("px0", "py0", "px1", "py1"), (10, 10, 13, 14), strict=True)}
    asked = parts.select("key", how.alias("source")).withColumns(drawn)
    rows = polygons.resolve_direction(asked, polygons.boundary_axes(parts, ["key"]), ["key"])
    return _rounded(rows.withColumnRenamed("key", "part_id"), "ux", "uy")


@query(
    f"""WITH det AS ({d.DETECTIONS_SQL}), a AS (SELECT x.idx AS a, y.idx AS b, x.raster_id, greatest(least(x.gx1, y.gx1) - greatest(x.gx0, y.gx0), 0) * greatest(least(x.gy1, y.gy1) - greatest(x.gy0, y.gy0), 0) AS common,
    (x.gx1 - x.gx0) * (x.gy1 - x.gy0) AS area_a, (y.gx1 - y.gx0) * (y.gy1 - y.gy0) AS area_b FROM det x JOIN det y ON x.raster_id = y.raster_id AND x.row = y.row AND x.col = y.col AND x.idx < y.idx)
    SELECT raster_id, a, b, round(common / (area_a + area_b - common), 6) + 0 AS iou, round(common / least(area_a, area_b), 6) + 0 AS ios FROM a"""
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the boxes of one slice."""
    rows = d.detections(spark, sf_dir)
    one, two = (rows.select("raster_id", "row", "col", F.col("idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in suppress.BOX]) for s in "ab")
    pair = grids.all_pairs(one, two, ["raster_id", "row", "col"], "a", "b").where("a < b")
    boxes = [tuple(F.col(f"{c}_{s}") for c in suppress.BOX) for s in "ab"]
    rounded = lambda v: F.when(v == 0, F.lit(0.0)).otherwise(r6(v))  # noqa: E731  most boxes are apart
    return pair.select("raster_id", "a", "b", rounded(geom.iou(*boxes)).alias("iou"), rounded(geom.ios(*boxes)).alias("ios"))


_GRID = """
  b AS (SELECT n_nationkey AS n, radians(7 * n_nationkey) AS t, CASE WHEN cos(radians(7 * n_nationkey)) < 0 THEN -1 ELSE 1 END AS s, 2.0 * (40 + 3 * n_nationkey) AS w, 2.0 * (15 + n_nationkey % 7) AS h FROM nation),
  g AS (SELECT *, s * cos(t) AS ux, s * sin(t) AS uy, (w - 3 * 1.5) / 4 AS cw, (h - 2 * 0.5) / 3 AS ch, 60 * (n % 5) + 60 - s * cos(t) * w / 2 + s * sin(t) * h / 2 AS ox, 22 - s * sin(t) * w / 2 - s * cos(t) * h / 2 AS oy FROM b),
  cells AS (SELECT n::BIGINT AS part_id, row, col, ox + col * (cw + 1.5) * ux - row * (ch + 0.5) * uy AS x, oy + col * (cw + 1.5) * uy + row * (ch + 0.5) * ux AS y
            FROM g, (SELECT unnest([0, 1, 2])::INT AS row), (SELECT unnest([0, 1, 2, 3])::INT AS col))"""


def _cells(spark: SparkSession, sf_dir: str, keep: str = "all") -> DataFrame:
    parts = d.boundaries(spark, sf_dir).drop("field_id").withColumnRenamed("part_id", "key").withColumn("part_id", F.lit(0))
    return polygons.subplots(parts, 3, 4, x_spacing=1.5, y_spacing=0.5, keep=keep, by=["key"]).withColumnRenamed("key", "part_id")


@query(f"WITH {_GRID} SELECT part_id, row_number() OVER (PARTITION BY part_id ORDER BY row, col) AS id, row, col, round(x, 5) + 0 AS x, round(y, 5) + 0 AS y FROM cells")
def subplots_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("ring", 0)
    return _cells(spark, sf_dir).select("part_id", "id", "row", "col", (F.round(first["x"], 5) + F.lit(0.0)).alias("x"), (F.round(first["y"], 5) + F.lit(0.0)).alias("y"))


@query(
    """WITH n AS (SELECT n_nationkey::BIGINT AS part_id, radians(7 * n_nationkey) AS t, CASE WHEN cos(radians(7 * n_nationkey)) < 0 THEN -1 ELSE 1 END AS s FROM nation)
    SELECT part_id, round(degrees(atan2(s * sin(t), s * cos(t))), 6) + 0 AS angle FROM n"""
)
def optimal_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = d.boundaries(spark, sf_dir).drop("field_id").withColumnRenamed("part_id", "key").withColumn("part_id", F.lit(0))
    return _rounded(polygons.optimal_rotation(parts, ["key"]).withColumnRenamed("key", "part_id"), "angle")


@query(
    f"""WITH c AS ({d.BOUNDARIES_SQL}) SELECT n_nationkey::BIGINT AS part_id,
    round(60 * (n_nationkey % 5) + 60 - (40 + 3 * n_nationkey) * cos(t), 5) + 0 AS x0, round(22 - (40 + 3 * n_nationkey) * sin(t), 5) + 0 AS y0,
    round(60 * (n_nationkey % 5) + 60 + (40 + 3 * n_nationkey) * cos(t), 5) + 0 AS x1, round(22 + (40 + 3 * n_nationkey) * sin(t), 5) + 0 AS y1 FROM (SELECT *, radians(7 * n_nationkey) AS t FROM nation)"""
)
def direction_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line through each rectangle's centre along its own long side."""
    rows = polygons.vertices_of(d.boundaries(spark, sf_dir)).select(F.col("part_id").alias("key"), "x", "y")
    along = rows.select("key").distinct().select("key", F.cos(F.radians(7.0 * F.col("key"))).alias("ux"), F.sin(F.radians(7.0 * F.col("key"))).alias("uy"))
    out = polygons.direction_segments(rows, along, ["key"]).withColumnRenamed("key", "part_id")
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("x0", "y0", "x1", "y1")})


@query(f"WITH c AS ({d.BOUNDARIES_SQL}) SELECT field_id, count(DISTINCT part_id) AS n, 'not exactly one boundary' AS problem FROM c GROUP BY field_id HAVING count(DISTINCT part_id) <> 1")
def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.boundary_violations(d.boundaries(spark, sf_dir), single=True)


@query(f"WITH c AS ({d.BOUNDARIES_SQL}) SELECT field_id, part_id, k::INT AS at, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM c")
def boundary_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(polygons.vertices_of(d.boundaries(spark, sf_dir)).drop("ring"), "x", "y")


def _grid_and_area(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells of every nation's grid, and an L of two rectangles that all of them are held against."""
    ell = [(0, 0), (300, 0), (300, 25), (120, 25), (120, 60), (0, 60)]
    ring = F.array(*[geom.point(F.lit(float(x)), F.lit(float(y))) for x, y in ell])
    cells = _cells(spark, sf_dir)
    return cells, cells.select("part_id").distinct().select("part_id", F.array(ring).alias("rings"))


# A cell lies in the L if no corner is outside it and the inner corner of the L is not inside the cell.
@query(
    f"""WITH {_GRID}, corners AS (SELECT part_id, row, col, g.ux, g.uy, cw, ch, x + a * cw * ux - b * ch * uy AS x, y + a * cw * uy + b * ch * ux AS y, cells.x AS x0, cells.y AS y0
      FROM cells JOIN g ON g.n = cells.part_id, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS corner(a, b)),
    k AS (SELECT part_id, row, col, bool_and(x >= 0 AND x <= 300 AND y >= 0 AND y <= 60 AND (y <= 25 OR x <= 120)) AS good,
      bool_or((120 - x0) * ux + (25 - y0) * uy > 0 AND (120 - x0) * ux + (25 - y0) * uy < cw AND (25 - y0) * ux - (120 - x0) * uy > 0 AND (25 - y0) * ux - (120 - x0) * uy < ch) AS hit FROM corners GROUP BY ALL)
    SELECT part_id, row, col FROM k WHERE good AND NOT hit"""
)
def subplots_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, area = _grid_and_area(spark, sf_dir)
    return polygons.keep_cells(cells, area, "inside", by=["part_id"]).select("part_id", "row", "col")


@query(
    f"""WITH {_GRID} SELECT part_id, row, col, 'P' || 'R' || (row + 1) || 'C' || (col + 10) AS label,
    'P' || row_number() OVER (PARTITION BY part_id ORDER BY row, CASE WHEN row % 2 = 1 THEN -col ELSE col END) AS serpentine FROM cells"""
)
def subplot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.subplot_labels(_cells(spark, sf_dir), start_col=10, prefix="P", by=["part_id"])
    snake = labels.subplot_labels(rows.withColumnRenamed("label", "first"), "serpentine", prefix="P", by=["part_id"])
    return snake.select("part_id", "row", "col", F.col("first").alias("label"), F.col("label").alias("serpentine"))


# Rasters.

_WINDOWS = f"""
  r AS ({d.RASTERS_SQL}),
  ys AS (SELECT raster_id, y0, row_number() OVER (PARTITION BY raster_id ORDER BY y0) - 1 AS row FROM (SELECT DISTINCT raster_id, unnest(list_append(generate_series(0, greatest(height - 256, 0), 204), greatest(height - 256, 0))) AS y0 FROM r)),
  xs AS (SELECT raster_id, x0, row_number() OVER (PARTITION BY raster_id ORDER BY x0) - 1 AS col FROM (SELECT DISTINCT raster_id, unnest(list_append(generate_series(0, greatest(width - 256, 0), 204), greatest(width - 256, 0))) AS x0 FROM r)),
  win AS (SELECT r.raster_id, row::INT AS row, col::INT AS col, x0::INT AS x0, y0::INT AS y0, least(x0 + 256, width)::INT AS x1, least(y0 + 256, height)::INT AS y1, width, height FROM r JOIN xs USING (raster_id) JOIN ys USING (raster_id))"""


@query(f"WITH {_WINDOWS} SELECT raster_id, row, col, x0, y0, x1, y1 FROM win")
def slice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.slice_windows(d.rasters(spark, sf_dir), 256, 0.2).select("raster_id", "row", "col", "x0", "y0", "x1", "y1")


@query(f'WITH {_WINDOWS} SELECT raster_id, row, col, x0 = 0 AS "left", y0 = 0 AS top, x1 >= width AS "right", y1 >= height AS bottom FROM win')
def window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.window_edges(rasters.slice_windows(d.rasters(spark, sf_dir), 256, 0.2))
    return rows.select("raster_id", "row", "col", "edge.left", "edge.top", "edge.right", "edge.bottom")


@query(
    f"""WITH {_WINDOWS} SELECT raster_id, row, col FROM win
    WHERE 0.1 * x1 + 100 + raster_id >= 110 + raster_id AND 0.1 * x0 + 100 + raster_id <= 130 + raster_id AND 200 - 0.1 * y0 >= 170 AND 200 - 0.1 * y1 <= 190"""
)
def slice_grid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = d.rasters(spark, sf_dir)
    left, right = (F.lit(10) + F.col("c")), (F.lit(30) + F.col("c"))
    ring = geom.box_ring(left, F.lit(170.0), right, F.lit(190.0))
    area = r.select("raster_id", F.array(ring).alias("rings"))
    return rasters.slice_grid(r, area, 256, 0.2).select("raster_id", "row", "col")


@query(f'WITH r AS ({d.RASTERS_SQL}) SELECT raster_id, c AS "left", round(f - 0.1 * height, 6) AS bottom, round(c + 0.1 * width, 6) AS "right", f AS top FROM r')
def raster_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rasters.raster_catalog(d.rasters(spark, sf_dir)).select("raster_id", "left", "bottom", "right", "top"), "bottom", "right")


_PIXELS = f"""
  t AS ({d.TILES_SQL}), px AS (SELECT raster_id, tile_row * 8 + (i - 1) // 8 AS y, tile_col * 8 + (i - 1) % 8 AS x, embedding[i]::DOUBLE AS v FROM t, (SELECT unnest(generate_series(1, 64)) AS i)),
  win AS (SELECT DISTINCT raster_id, row, col, 20 * col - 5 AS x0, 12 * row - 3 AS y0 FROM (SELECT DISTINCT raster_id FROM t), (SELECT unnest([0, 1, 2])::INT AS row), (SELECT unnest([0, 1, 2])::INT AS col)),
  cell AS (SELECT *, x0 + dx AS x, y0 + dy AS y FROM win, (SELECT unnest(generate_series(0, 23)) AS dx), (SELECT unnest(generate_series(0, 15)) AS dy)),
  full_ AS (SELECT raster_id, row, col, list(coalesce(v, 0) ORDER BY y, x) AS pixels, count(v) AS hit FROM cell LEFT JOIN px USING (raster_id, x, y) GROUP BY ALL)"""


def _pixel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, three = d.tiles(spark, sf_dir), F.sequence(F.lit(0), F.lit(2))
    w = t.select("raster_id").distinct().withColumn("row", F.explode(three)).withColumn("col", F.explode(three))
    w = w.withColumns({"x0": 20 * F.col("col") - 5, "y0": 12 * F.col("row") - 3})
    return rasters.read_windows(t, w.withColumns({"x1": F.col("x0") + 24, "y1": F.col("y0") + 16}))


@query(
    f"""WITH {_PIXELS} SELECT raster_id, row, col, len(pixels)::INT AS n, round(list_sum(pixels), 4) + 0 AS total, round(pixels[130], 6) + 0 AS one, round(pixels[384], 6) + 0 AS last
    FROM full_"""
)
def window_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 4) + F.lit(0.0)
    return _pixel_windows(spark, sf_dir).select("raster_id", "row", "col", F.size("pixels").alias("n"), total.alias("total"), r6(F.get("pixels", 129)).alias("one"), r6(F.get("pixels", 383)).alias("last"))


@query(
    f"""WITH {_PIXELS}, s AS (SELECT raster_id, row, col, list_max(pixels) AS top, pixels FROM full_)
    SELECT raster_id, row, col, list_sum(list_transform(pixels, lambda v: CASE WHEN top > 0 THEN trunc(v / top * 255) ELSE 0 END))::BIGINT AS total FROM s"""
)
def image_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.normalize_images(_pixel_windows(spark, sf_dir))
    return rows.select("raster_id", "row", "col", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


def bright_pixels() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A predictor for tests: how many pixels of a window are over 0.2."""

    def predict(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["raster_id", "row", "col"]].assign(n=[int((p > 0.2).sum()) for p in rows["pixels"]])

    return predict


@query(f"WITH {_PIXELS} SELECT raster_id, row, col, len(list_filter(pixels, lambda v: v > 0.2)) AS n FROM full_")
def tile_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.detect(_pixel_windows(spark, sf_dir), bright_pixels, "raster_id long, row int, col int, n long")


@query(
    f"""WITH p AS ({d.SCATTER_SQL}), r AS ({d.RASTERS_SQL}), m AS (SELECT raster_id % 10 AS field_id, * EXCLUDE (raster_id), raster_id FROM r)
    SELECT p.field_id, fid, raster_id, round(x - 0.75, 6) + 0 AS "left", round(y - 0.75, 6) + 0 AS bottom, round(x + 0.75, 6) + 0 AS "right", round(y + 0.75, 6) + 0 AS top FROM p JOIN m USING (field_id)"""
)
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = d.rasters(spark, sf_dir).withColumn("field_id", F.col("raster_id") % 10)
    rows = rasters.crop_windows(d.scatter(spark, sf_dir), dated, 1.5, digits=6)
    return rows.select("field_id", "fid", "raster_id", "left", "bottom", "right", "top")


# Edits and names.


@query(
    f"""WITH e AS ({d.EDITS_SQL}) SELECT field_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, arg_max(action, seq) AS value, count(*) AS n FROM
    (SELECT *, sum(new) OVER (PARTITION BY field_id ORDER BY ts, seq) AS burst FROM (SELECT *, (lag(ts) OVER (PARTITION BY field_id ORDER BY ts, seq) IS NULL OR ts - lag(ts) OVER (PARTITION BY field_id ORDER BY ts, seq) >= INTERVAL 4 HOUR)::INT AS new FROM e))
    GROUP BY field_id, burst"""
)
def edit_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = d.edits(spark, sf_dir).withColumnRenamed("action", "value")
    return ed.debounce(changes, "4 hours", by="field_id").select("field_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"), "value", "n")


_POINT = "STRUCT(fid BIGINT, x DOUBLE, y DOUBLE)[]"
_STEP = "STRUCT(did VARCHAR, fid BIGINT, x DOUBLE, y DOUBLE)[]"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY seq) AS nr FROM ({d.EDITS_SQL})),
    w AS (
      SELECT field_id, 0::BIGINT AS nr, []::{_POINT} AS pts, []::{_STEP} AS stack, 0::BIGINT AS nxt FROM e GROUP BY field_id
      UNION ALL
      SELECT field_id, nr,
        CASE WHEN action = 'add' THEN list_append(pts, struct_pack(fid := nxt, x := x, y := y))
             WHEN action = 'undo' AND len(stack) > 0 THEN CASE WHEN stack[-1].did = 'add' THEN rest_undo ELSE list_append(rest_undo, struct_pack(fid := stack[-1].fid, x := stack[-1].x, y := stack[-1].y)) END
             WHEN action = 'move' AND len(hit) > 0 THEN list_append(rest, struct_pack(fid := fid, x := x, y := y))
             WHEN action = 'delete' AND len(hit) > 0 THEN rest ELSE pts END,
        CASE WHEN action = 'add' THEN list_append(stack, struct_pack(did := 'add', fid := nxt, x := NULL::DOUBLE, y := NULL::DOUBLE))
             WHEN action = 'undo' AND len(stack) > 0 THEN stack[:-2]
             WHEN action IN ('move', 'delete') AND len(hit) > 0 THEN list_append(stack, struct_pack(did := action, fid := fid, x := hit[1].x, y := hit[1].y)) ELSE stack END,
        nxt + (action = 'add')::INT
      FROM (SELECT w.field_id, e.nr, w.pts, w.stack, w.nxt, e.action, e.fid, e.x, e.y, list_filter(w.pts, lambda p: p.fid = e.fid) AS hit, list_filter(w.pts, lambda p: p.fid <> e.fid) AS rest,
              list_filter(w.pts, lambda p: p.fid <> w.stack[-1].fid) AS rest_undo FROM w JOIN e ON e.field_id = w.field_id AND e.nr = w.nr + 1)),
    last AS (SELECT field_id, arg_max(pts, nr) AS pts FROM w GROUP BY field_id)
    SELECT field_id, p.fid AS fid, p.x AS x, p.y AS y FROM (SELECT field_id, unnest(pts) AS p FROM last)"""
)
def edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.replay(d.edits(spark, sf_dir))


@query(
    f"""WITH p AS ({d.PATHS_SQL}), o AS (SELECT path, min(page_id) AS nth FROM p WHERE page_id % 3 = 0 GROUP BY path), n AS (SELECT path, min(page_id) AS nth FROM p WHERE page_id % 3 <> 0 GROUP BY path)
    SELECT path, 0 AS source, nth FROM o UNION ALL SELECT path, 1, nth FROM n WHERE path NOT IN (SELECT path FROM o)"""
)
def merge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.paths(spark, sf_dir).withColumnRenamed("page_id", "nth")
    return labels.merge_paths(p.where("nth % 3 = 0"), p.where("nth % 3 <> 0"))


@query(
    f"""WITH p AS (SELECT DISTINCT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM ({d.PATHS_SQL})),
    s AS (SELECT path, regexp_replace(parts[-1], '^(.+)\\.[^.]*$', '\\1') AS stem, parts[:-2] AS dirs FROM p WHERE len(parts) > 0),
    c AS (SELECT stem, count(*) AS same, min(len(dirs)) AS shallow FROM s GROUP BY stem),
    k AS (SELECT stem, min(pos) AS differ FROM (SELECT stem, i AS pos FROM s, (SELECT unnest(generate_series(0, 20)) AS i) WHERE i < len(dirs) GROUP BY stem, i HAVING count(DISTINCT dirs[i + 1]) > 1) GROUP BY stem)
    SELECT path, CASE WHEN same = 1 THEN stem ELSE stem || ' (.../' || coalesce(dirs[least(coalesce(differ, shallow), shallow) + 1], dirs[-1], '') || '/...)' END AS name
    FROM s JOIN c USING (stem) LEFT JOIN k USING (stem)"""
)
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.catalog_names(d.paths(spark, sf_dir))


@query(
    f"""WITH RECURSIVE n AS (SELECT DISTINCT l.label::BIGINT + 10 * k AS id, 'layer' || (l.label % 3) AS name FROM embeddings l, (SELECT unnest([0, 1, 2]) AS k)),
    o AS (SELECT id, name, row_number() OVER (ORDER BY id) AS nr FROM n),
    w AS (SELECT 0::BIGINT AS nr, ['layer0', 'layer1_1', 'layer2_2'] AS taken, NULL::BIGINT AS id, NULL::VARCHAR AS name, NULL::VARCHAR AS unique_name
      UNION ALL
      SELECT nr, list_append(taken, new), id, name, new FROM (
        SELECT o.nr, w.taken, o.id, o.name, CASE WHEN NOT list_contains(w.taken, o.name) THEN o.name
          ELSE o.name || '_' || list_min(list_filter(generate_series(1, 99), lambda k: NOT list_contains(w.taken, o.name || '_' || k))) END AS new
        FROM w JOIN o ON o.nr = w.nr + 1))
    SELECT id, name, unique_name FROM w WHERE nr > 0"""
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label").distinct()
    rows = rows.withColumn("k", F.explode(F.array(F.lit(0), F.lit(10), F.lit(20)))).select((F.col("k") + F.col("label").cast("long")).alias("id"), F.concat(F.lit("layer"), (F.col("label") % 3).cast("string")).alias("name"))
    taken = spark.createDataFrame([("layer0",), ("layer1_1",), ("layer2_2",)], "name string")
    return labels.unique_names(rows, taken)


@query(f"WITH r AS ({d.RASTERS_SQL}) SELECT raster_id % 4 AS field_id, arg_max(raster_id, (raster_id * 7) % 101 * 1000000 + raster_id) AS raster_id FROM r WHERE raster_id % 3 <> 0 GROUP BY raster_id % 4")
def active_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = d.rasters(spark, sf_dir).withColumns({"field_id": F.col("raster_id") % 4, "visible": F.col("raster_id") % 3 != 0, "layer_order": (F.col("raster_id") * 7) % 101})
    return labels.active_raster(r)


@query(
    f"""WITH p AS ({d.SCATTER_SQL}), m AS (SELECT field_id, fid, x / 2 AS lon, y / 2 AS lat FROM p)
    SELECT field_id, fid, round(radians(lon) * 6378137, 3) + 0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) + 0 AS y FROM m"""
)
def points_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geom.reproject(F.col("x") / 2, F.col("y") / 2, "EPSG:4326", "EPSG:3857")
    return d.scatter(spark, sf_dir).select("field_id", "fid", (F.round(x, 3) + F.lit(0.0)).alias("x"), (F.round(y, 3) + F.lit(0.0)).alias("y"))

