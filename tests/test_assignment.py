"""Points in ridge intervals through buckets, against every interval."""

import random

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import points as pt
from fieldspark.operators import ridges


def brute(perp, intervals):
    found = [(abs(c - perp), i) for i, lo, hi, c in intervals if perp is not None and lo <= perp <= hi]
    return min(found)[1] if found else -1


@pytest.mark.parametrize("kind", ["apart", "overlapping", "one", "closed ends", "very unequal"])
def test_assignment_against_every_interval(spark, kind):
    rng = random.Random(kind)
    if kind == "apart":
        ends = [(k * 2.0, k * 2.0 + 1.0) for k in range(300)]
    elif kind == "overlapping":
        ends = [(lo, lo + rng.uniform(0, 80)) for lo in (rng.uniform(0, 100) for _ in range(60))]
    elif kind == "one":
        ends = [(3.0, 3.0)]
    elif kind == "closed ends":
        ends = [(float(k), float(k + 1)) for k in range(40)]
    else:
        ends = [(0.0, 1e9), *((k * 1e-3, k * 1e-3 + 1e-6) for k in range(50))]
    intervals = [(i, lo, hi, (lo + hi) / 2) for i, (lo, hi) in enumerate(ends)]
    spots = [rng.choice(rng.choice(ends)) + rng.choice([0.0, 0.0, 0.25, -0.5]) for _ in range(400)] + [None, -1e12, 1e12]
    values = spark.createDataFrame([(1, i, p, i % 7 != 0, 5) for i, p in enumerate(spots)] + [(2, 0, 1.0, True, 5)], "field_id int, fid long, perp double, effective boolean, lo int")
    table = spark.createDataFrame([(1, *r) for r in intervals] + [(1, 10_000, 5.0, 4.0, 4.5)], "field_id int, ridge_id long, lo double, hi double, center double")
    out = ridges.assign_ridges(values, table)
    assert out.columns == [*values.columns, "ridge_id", "is_inlier"]
    got = {(r.field_id, r.fid): (r.ridge_id, r.is_inlier) for r in out.collect()}
    want = {(1, i): brute(p, intervals) if i % 7 else -1 for i, p in enumerate(spots)} | {(2, 0): -1}
    assert got == {k: (v, v >= 0) for k, v in want.items()}


def test_ten_thousand_ridges_cost_as_few(spark):
    """A bucket holds a few ridges, however many a field has."""
    table = spark.range(10_000).select(F.lit(1).alias("field_id"), F.col("id").alias("ridge_id"), (F.col("id") * 2.0).alias("lo"), (F.col("id") * 2.0 + 2.0).alias("hi"), (F.col("id") * 2.0 + 1).alias("center"))
    values = spark.range(50_000).select(F.lit(1).alias("field_id"), F.col("id").alias("fid"), (F.rand(3) * 20_000).alias("perp"))
    out = ridges.assign_ridges(values, table)
    assert out.where(F.col("ridge_id") != F.floor(F.col("perp") / 2)).count() == 0 and out.count() == 50_000


def test_only_keys_with_a_missing_fid_are_numbered(spark):
    rows = [(1, 10, 3.0, 0.0), (1, 20, 1.0, 0.0), (2, 5, 2.0, 0.0), (2, None, 1.0, 0.0), (None, None, 9.0, 0.0), (None, 7, 8.0, 0.0)]
    points = spark.createDataFrame(rows, "field_id int, fid long, x double, y double")
    got = sorted(((r.field_id, r.x, r.fid) for r in pt.normalize_points(points).collect()), key=str)
    assert got == sorted([(1, 3.0, 10), (1, 1.0, 20), (2, 2.0, 1), (2, 1.0, 0), (None, 9.0, 1), (None, 8.0, 0)], key=str)
    with pytest.raises(ValueError, match="missing"):
        pt.normalize_points(points.drop("x"))
