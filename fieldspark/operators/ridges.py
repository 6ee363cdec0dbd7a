"""Crop rows (ridges) from the density of plants across a direction, and plants in order along them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoint import written
from ..functions import geom
from .suppress import spaced_peaks

BY = ["field_id"]


def _by(by: list[str] | None) -> list[str]:
    return by or BY


def _checked(**values: tuple[float, bool]) -> None:
    for name, (value, good) in values.items():
        if not good:
            raise ValueError(f"{name} may not be {value}")


def origins(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean x and y of each key as ox, oy."""
    return points.groupBy(*_by(by)).agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.count("*").alias("n_points"))


def projected(points: DataFrame, directions: DataFrame, origin: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds along and perp: projections on the key's direction (ux, uy) and its left normal, from the origin (mean of the points).

    Keys without a direction, or with fewer than two points, are left out.
    """
    by = _by(by)
    frame = (origin or origins(points, by)).join(directions.select(*by, "ux", "uy"), by).where("n_points >= 2")
    along, perp = geom.project(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), F.col("ux"), F.col("uy"))
    return points.join(frame, by).withColumns({"along": along, "perp": perp}).drop("n_points")


def density_histogram(values: DataFrame, width: float, value: str = "perp", by: list[str] | None = None) -> DataFrame:
    """(by.., bin, x_bin, n): counts of floor(value / width), every bin from the least to the greatest; x_bin is the left edge."""
    _checked(width=(width, width > 0))
    by = _by(by)
    counts = values.groupBy(*by, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    span = counts.groupBy(*by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    every = span.select(*by, F.explode(F.sequence("lo", "hi")).alias("bin"))
    full = every.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.select(*by, "bin", (F.col("bin") * width).alias("x_bin"), "n")


def local_maxima(density: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bins strictly above both neighbouring runs of equal counts; a plateau gives its middle, rounded down; ends never count."""
    by = _by(by)
    order = W.partitionBy(*by).orderBy("bin")
    steps = density.withColumn("new", F.coalesce((F.col("n") != F.lag("n").over(order)).cast("int"), F.lit(1)))
    runs = steps.withColumn("run", F.sum("new").over(order)).groupBy(*by, "run").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.first("n").alias("n"), F.min("x_bin").alias("x_lo"), F.max("x_bin").alias("x_hi"))
    near = W.partitionBy(*by).orderBy("run")
    peaks = runs.withColumns({"before": F.lag("n").over(near), "after": F.lead("n").over(near)}).where("n > before and n > after")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    step = (F.col("x_hi") - F.col("x_lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return peaks.select(*by, middle.alias("bin"), (F.col("x_lo") + (middle - F.col("lo")) * step).alias("x_bin"), "n")


def ridge_peaks(density: DataFrame, distance: int = 1, height: float = 20, by: list[str] | None = None) -> DataFrame:
    """(by.., ridge_index, bin, peak_x, peak_height): local maxima of at least height, then spaced by distance bins, by ascending bin."""
    _checked(distance=(distance, distance >= 1), height=(height, height >= 0))
    by = _by(by)
    kept = spaced_peaks(local_maxima(density, by).where(F.col("n") >= height), F.lit(distance), by)
    index = F.row_number().over(W.partitionBy(*by).orderBy("bin")).cast("long") - 1
    return kept.select(*by, index.alias("ridge_index"), "bin", F.col("x_bin").alias("peak_x"), F.col("n").alias("peak_height"))


def ridge_lines(values: DataFrame, peaks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., ridge_index, x0, y0, x1, y1): for each peak a segment along the direction over the extent of the points.

    values is the result of projected().
    """
    by = _by(by)
    extent = values.groupBy(*by).agg(F.min("along").alias("lo"), F.max("along").alias("hi"), *[F.first(c).alias(c) for c in ("ox", "oy", "ux", "uy")])
    rows = peaks.join(extent, by)
    base_x, base_y = F.col("ox") - F.col("uy") * F.col("peak_x"), F.col("oy") + F.col("ux") * F.col("peak_x")
    ends = {f"{c}{k}": base + F.col(u) * F.col(t) for k, t in ((0, "lo"), (1, "hi")) for c, base, u in (("x", base_x, "ux"), ("y", base_y, "uy"))}
    return rows.select(*by, "ridge_index", *[ends[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


def profile_range(density: DataFrame, peaks: DataFrame, height: float, by: list[str] | None = None) -> DataFrame:
    """(by.., y_min, y_max) over counts, peak heights and the threshold: padded by 5 %, or by 0.5 if flat."""
    by = _by(by)
    rows = density.select(*by, F.col("n").cast("double").alias("v")).unionByName(peaks.select(*by, F.col("peak_height").cast("double").alias("v")))
    span = rows.groupBy(*by).agg(F.least(F.min("v"), F.lit(float(height))).alias("lo"), F.greatest(F.max("v"), F.lit(float(height))).alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * 0.05).otherwise(0.5)
    return span.select(*by, (F.col("lo") - pad).alias("y_min"), (F.col("hi") + pad).alias("y_max"))


def detect_ridges(
    points: DataFrame, directions: DataFrame, width: float = 1.0, distance: int = 1, height: float = 20, by: list[str] | None = None, metres: float | None = None
) -> dict[str, DataFrame]:
    """density, peaks and lines of the effective points (all, if there is no column effective).

    Peaks are distance bins apart, or metres, which are rounded up to whole bins.
    """
    if metres is not None:
        distance = max(1, math.ceil(metres / width)) if metres > 0 and width > 0 else 1
    points = points.where("effective") if "effective" in points.columns else points
    values = projected(points, directions, by=by)
    density = density_histogram(values, width, by=by)
    peaks = ridge_peaks(density, distance, height, by)
    return {"density": density, "peaks": peaks, "lines": ridge_lines(values, peaks, by)}


def ridge_intervals(peaks: DataFrame, buffer: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """(by.., ridge_id, lo, hi, center): midpoints between peaks; outside, the larger of buffer and half the gap."""
    _checked(buffer=(buffer, buffer > 0))
    by = _by(by)
    order = W.partitionBy(*by).orderBy("peak_x")
    before, after, x = F.lag("peak_x").over(order), F.lead("peak_x").over(order), F.col("peak_x")
    least = F.lit(float(buffer))
    lo = F.coalesce((before + x) / 2, x - F.greatest(least, F.coalesce((after - x) / 2, least)))
    hi = F.coalesce((x + after) / 2, x + F.greatest(least, F.coalesce((x - before) / 2, least)))
    rows = peaks.select(*by, (F.row_number().over(order).cast("long") - 1).alias("ridge_id"), lo.alias("lo"), hi.alias("hi"))
    return rows.withColumn("center", (F.col("lo") + F.col("hi")) / 2)


def assign_ridges(values: DataFrame, intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ridge_id (-1: none, or not effective) and is_inlier; closed intervals, the nearest centre, on ties the lowest id.

    values needs a unique fid in each key. A key's axis is cut in buckets, so many that its intervals stand in about two each; a
    point looks into its own bucket only, and is never multiplied.
    """
    by = _by(by)
    width = F.greatest((F.max("hi") - F.min("lo")) / F.count("*"), F.sum(F.col("hi") - F.col("lo")) / F.count("*"), F.lit(1e-9))
    axis = intervals.where("lo <= hi").groupBy(*by).agg(F.min("lo").alias("_base"), width.alias("_width"))
    bucket = lambda c: F.floor((F.col(c) - F.col("_base")) / F.col("_width"))
    dealt = intervals.where("lo <= hi").join(axis, by).withColumn("_bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    lists = dealt.groupBy(*by, "_bucket").agg(F.collect_list(F.struct("ridge_id", "lo", "hi", "center")).alias("ridges"))
    effective = F.coalesce(F.col("effective"), F.lit(True)) if "effective" in values.columns else F.lit(True)
    hit = F.filter("ridges", lambda r: (r["lo"] <= F.col("perp")) & (F.col("perp") <= r["hi"]))
    best = F.array_min(F.transform(hit, lambda r: F.struct(F.abs(r["center"] - F.col("perp")).alias("d"), r["ridge_id"].alias("ridge_id"))))
    rows = values.join(axis, by, "left").withColumn("_bucket", bucket("perp")).join(lists, [*by, "_bucket"], "left")
    rows = rows.withColumn("ridge_id", F.when(effective, best["ridge_id"]))
    rows = rows.withColumns({"ridge_id": F.coalesce("ridge_id", F.lit(-1).cast("long")), "is_inlier": F.col("ridge_id").isNotNull()})
    return rows.select(*values.columns, *[c for c in ("ridge_id", "is_inlier") if c not in values.columns])


#: Points of a ridge that one task compares with the ridge's lines.
SHARE = 50_000
# Pairs of places (i, j) are tried in order of (i * 7919 + j * 104729) modulo 1000003, then i, then j.
_I, _J, _MODULUS = 7919, 104729, 1000003


def trial_pairs(n: int, trials: int) -> tuple[np.ndarray, np.ndarray]:
    """The first so many pairs i < j of n places in the scrambled order; all pairs in plain order if there are no more."""
    every = n * (n - 1) // 2
    if every <= trials:
        return np.triu_indices(n, 1)
    if every <= 2_000_000:
        i, j = np.triu_indices(n, 1)
        first = np.lexsort((j, i, (i * _I + j * _J) % _MODULUS))[:trials]
        return i[first], j[first]
    # For one value of the scramble each i has a single class of partners, so pairs are listed value by value.
    inverse, i = pow(_J, -1, _MODULUS), np.arange(n, dtype=np.int64)
    found_i, found_j, have, value = [], [], 0, 0
    while have < trials:
        least = (value - i * _I) % _MODULUS * inverse % _MODULUS
        row, col = [], []
        for step in range(-(-n // _MODULUS)):
            j = least + step * _MODULUS
            good = (j > i) & (j < n)
            row.append(i[good])
            col.append(j[good])
        r, c = np.concatenate(row), np.concatenate(col)
        order = np.lexsort((c, r))
        found_i.append(r[order])
        found_j.append(c[order])
        have, value = have + len(r), value + 1
    return np.concatenate(found_i)[:trials], np.concatenate(found_j)[:trials]


def _listed(by: list[str], trials: int):
    def run(batches):
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                i, j = trial_pairs(int(row[-1]), trials)
                part = pd.DataFrame({"nr": np.arange(len(i)), "i": i.astype(np.int64), "j": j.astype(np.int64)})
                for at, name in enumerate([*by, "ridge_id"]):
                    part.insert(at, name, row[at])
                out.append(part)
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _counted(by: list[str], residual: float):
    """How many points of a share of a ridge lie near each line, and their squared errors."""

    def run(points: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        x, y = points["along"].to_numpy(float), points["perp"].to_numpy(float)
        slope, shift = lines["slope"].to_numpy(float), lines["shift"].to_numpy(float)
        count, square = np.zeros(len(lines), np.int64), np.zeros(len(lines))
        wide = max(1, 2_000_000 // max(1, len(x)))
        for lo in range(0, len(lines), wide):
            error = np.abs(y[None, :] - slope[lo : lo + wide, None] * x[None, :] - shift[lo : lo + wide, None])
            good = error <= residual
            count[lo : lo + wide], square[lo : lo + wide] = good.sum(1), np.where(good, error**2, 0).sum(1)
        return lines[[*by, "ridge_id", "nr"]].assign(c=count, sq=square)

    return run


def ransac_inliers(assigned: DataFrame, residual: float = 50.0, max_trials: int = 1000, by: list[str] | None = None) -> DataFrame:
    """(by.., fid, ridge_id, is_inlier): a line perp = a * along + b for each ridge from pairs of its points.

    All pairs are tried if there are at most max_trials, else that many in a fixed scrambled order; the best has most
    points within residual, then least squared error. ridge_id never changes; ridges with fewer than two points keep their flags.
    Pairs are listed from a ridge's number of points, lines meet its points in shares of ``SHARE``, and counts of the shares are added up.
    """
    by = _by(by)
    ridge = [*by, "ridge_id"]
    rows = assigned.select(*ridge, "fid", "is_inlier", "along", "perp")
    on = rows.where("ridge_id >= 0").withColumn("i", F.row_number().over(W.partitionBy(*ridge).orderBy("fid")).cast("long") - 1)
    on = written(on, "ridge-points")
    counts = on.groupBy(*ridge).agg(F.count("*").alias("n")).where("n >= 2")
    kinds = {f.name: f.dataType.simpleString() for f in on.schema}
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in ridge)
    pairs = counts.mapInPandas(_listed(by, max_trials), f"{keys}, nr long, i long, j long")
    pairs = pairs.join(on.select(*ridge, "i", F.col("along").alias("x0"), F.col("perp").alias("y0")), [*ridge, "i"])
    pairs = pairs.join(on.select(*ridge, F.col("i").alias("j"), F.col("along").alias("x1"), F.col("perp").alias("y1")), [*ridge, "j"])
    slope = F.when(F.col("x0") == F.col("x1"), 0.0).otherwise(F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    shift = F.when(F.col("x0") == F.col("x1"), (F.col("y0") + F.col("y1")) / 2).otherwise(F.col("y0") - F.col("slope") * F.col("x0"))
    lines = written(pairs.withColumn("slope", slope).withColumn("shift", shift).select(*ridge, "nr", "slope", "shift"), "ridge-lines")
    share = (F.col("i") / SHARE).cast("long")
    shares = counts.select(*ridge, F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / SHARE).cast("long"))).alias("share"))
    met = on.withColumn("share", share).groupBy(*ridge, "share").cogroup(lines.join(shares, ridge).groupBy(*ridge, "share"))
    tried = met.applyInPandas(_counted(by, residual), f"{keys}, nr long, c long, sq double").groupBy(*ridge, "nr").agg(F.sum("c").alias("c"), F.sum("sq").alias("sq"))
    best = tried.groupBy(*ridge).agg(F.min_by("nr", F.struct((-F.col("c")).alias("c"), "sq", "nr")).alias("nr")).join(lines, [*ridge, "nr"]).drop("nr")
    near = F.abs(F.col("perp") - F.col("slope") * F.col("along") - F.col("shift")) <= residual
    fitted = on.join(best, ridge, "left").select(*by, "fid", "ridge_id", F.coalesce(near, "is_inlier").alias("is_inlier"))
    return fitted.unionByName(rows.where("ridge_id < 0").select(*by, "fid", "ridge_id", "is_inlier"))


def order_points(
    points: DataFrame,
    directions: DataFrame,
    peaks: DataFrame,
    buffer: float = 0.5,
    origin: str = "all",
    residual: float | None = None,
    max_trials: int = 2000,
    by: list[str] | None = None,
) -> DataFrame:
    """(by.., fid, x, y, ridge_id, is_inlier) for every point; keys without direction or peaks get -1 and false.

    origin "all" projects from the mean of all points, "effective" from that of the effective ones, which is the frame of the peaks.
    """
    by = _by(by)
    if origin not in ("all", "effective"):
        raise ValueError(f"origin may not be {origin}")
    base = points.where("effective") if origin == "effective" and "effective" in points.columns else points
    values = assign_ridges(projected(points, directions, origins(base, by), by), ridge_intervals(peaks, buffer, by), by)
    flags = ransac_inliers(values, residual, max_trials, by) if residual is not None else values.select(*by, "fid", "ridge_id", "is_inlier")
    rows = points.select(*by, "fid", "x", "y").join(flags, [*by, "fid"], "left")
    return rows.withColumns({"ridge_id": F.coalesce("ridge_id", F.lit(-1).cast("long")), "is_inlier": F.coalesce("is_inlier", F.lit(False))})


def ordering_stats(ordered: DataFrame, points: DataFrame, peaks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., total, effective, assigned, ignored, ridge_count)."""
    by = _by(by)
    mask = F.col("effective") if "effective" in points.columns else F.lit(True)
    total = points.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(mask).alias("effective"))
    assigned = ordered.groupBy(*by).agg(F.count_if(F.col("ridge_id") >= 0).alias("assigned"))
    count = peaks.groupBy(*by).agg(F.count("*").alias("ridge_count"))
    rows = total.join(assigned, by, "left").join(count, by, "left").fillna(0, ["assigned", "ridge_count"])
    effective = F.when(F.col("ridge_count") > 0, F.col("effective")).otherwise(0)
    return rows.select(*by, "total", effective.alias("effective"), "assigned", (F.col("total") - F.col("assigned")).alias("ignored"), "ridge_count")

