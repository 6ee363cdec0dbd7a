"""Literal cases of densities, peaks, ordering and robust fits."""

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import ridges


def values(spark, xs):
    return spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate(xs)], "field_id long, fid long, perp double, along double")


def density(spark, counts):
    return spark.createDataFrame([(1, i, float(i), n) for i, n in enumerate(counts)], "field_id long, bin long, x_bin double, n long")


def peak_table(spark, xs):
    return spark.createDataFrame([(1, i, i, float(x), 5) for i, x in enumerate(xs)], "field_id long, ridge_index long, bin long, peak_x double, peak_height long")


@pytest.mark.parametrize(
    ("xs", "bins", "counts"),
    [((0, 0.1, 0.2, 2, 2.1), [0, 1, 2], [3, 0, 2]), ((-4.1, -3.9, 0, 0.1, 4, 4.1), list(range(-5, 5)), [1, 1, 0, 0, 0, 2, 0, 0, 0, 2])],
)
def test_histogram(spark, xs, bins, counts):
    rows = ridges.density_histogram(values(spark, xs), 1.0).orderBy("bin").collect()
    assert [r.bin for r in rows] == bins and [r.n for r in rows] == counts


def test_peaks(spark):
    rows = ridges.ridge_peaks(density(spark, [0, 5, 0, 4, 0, 6, 0]), 2, 3).orderBy("bin").collect()
    assert [(r.ridge_index, r.bin, r.peak_height) for r in rows] == [(0, 1, 5), (1, 3, 4), (2, 5, 6)]
    assert ridges.ridge_peaks(density(spark, [3, 0, 2]), 1, 0).count() == 0  # the ends never count
    plateau = ridges.ridge_peaks(density(spark, [0, 4, 4, 4, 4, 0, 7, 0]), 1, 0).orderBy("bin").collect()
    assert [r.bin for r in plateau] == [2, 6]
    near = ridges.ridge_peaks(density(spark, [0, 5, 0, 5, 0, 5, 0]), 3, 0).orderBy("bin").collect()
    assert [r.bin for r in near] == [1, 5]  # of equal ones the greater bin goes first


@pytest.mark.parametrize("call", [lambda s: ridges.density_histogram(values(s, [0]), 0), lambda s: ridges.ridge_peaks(density(s, [0]), 0, 1), lambda s: ridges.ridge_peaks(density(s, [0]), 1, -1), lambda s: ridges.ridge_intervals(peak_table(s, [0]), 0)])
def test_wrong_parameters(spark, call):
    with pytest.raises(ValueError):
        call(spark)


def test_spacing_against_a_plain_loop(spark):
    import random

    random.seed(4)
    counts = [2 * random.randint(0, 30) + i % 2 for i in range(400)]  # neighbours differ, so there is no plateau
    tops = [i for i in range(1, len(counts) - 1) if counts[i] > counts[i - 1] and counts[i] > counts[i + 1]]
    kept: list[int] = []
    for i in sorted(tops, key=lambda i: (-counts[i], -i)):
        if all(abs(i - j) >= 7 for j in kept):
            kept.append(i)
    rows = ridges.ridge_peaks(density(spark, counts), 7, 0).collect()
    assert sorted(r.bin for r in rows) == sorted(kept)


@pytest.mark.parametrize(
    ("peaks", "buffer", "perp", "expected"),
    [((0,), 0.5, (-0.2, 0, 0.3), [0, 0, 0]), ((-2, 2), 0.5, (-2.1, -1.8, 1.9, 2.2), [0, 0, 1, 1]), ((0,), 0.5, (0.5, 0.51), [0, -1]), ((-2, 2), 0.8, (0,), [0])],
)
def test_assignment(spark, peaks, buffer, perp, expected):
    rows = ridges.assign_ridges(values(spark, perp), ridges.ridge_intervals(peak_table(spark, peaks), buffer)).orderBy("fid").collect()
    assert [r.ridge_id for r in rows] == expected
    assert [r.is_inlier for r in rows] == [e >= 0 for e in expected]


def test_ignored_points(spark):
    rows = ridges.assign_ridges(values(spark, (0, 0.1)).withColumn("effective", F.col("fid") == 0), ridges.ridge_intervals(peak_table(spark, (0,)), 0.5)).orderBy("fid").collect()
    assert [(r.ridge_id, r.is_inlier) for r in rows] == [(0, True), (-1, False)]


def assigned(spark, perp):
    return spark.createDataFrame([(1, i, 0, True, float(i), float(p)) for i, p in enumerate(perp)], "field_id long, fid long, ridge_id long, is_inlier boolean, along double, perp double")


def test_robust_fit(spark):
    rows = ridges.ransac_inliers(assigned(spark, (0, 1, 2, 7)), 0.2).orderBy("fid").collect()
    assert [r.is_inlier for r in rows] == [True, True, True, False] and {r.ridge_id for r in rows} == {0}
    loose, tight = (ridges.ransac_inliers(assigned(spark, (0, 1, 2, 3.8)), r).where("is_inlier").count() for r in (1.0, 0.2))
    assert loose > tight


def test_end_to_end_invariants(spark):
    points = spark.createDataFrame([(1, i, float(i % 3), float(4 * (i // 3)), i != 5) for i in range(6)], "field_id long, fid long, x double, y double, effective boolean")
    directions = spark.createDataFrame([(1, 1.0, 0.0)], "field_id long, ux double, uy double")
    found = ridges.detect_ridges(points, directions, 0.5, 2, 1)
    ordered = ridges.order_points(points, directions, found["peaks"], 0.8)
    assert ordered.count() == 6 and ordered.where("ridge_id < 0 and is_inlier").count() == 0
    s = ridges.ordering_stats(ordered, points, found["peaks"]).first()
    assert s.assigned + s.ignored == s.total == 6
    none = ridges.order_points(points, directions.limit(0), found["peaks"])
    assert none.where("ridge_id = -1 and not is_inlier").count() == 6


def test_trial_pairs_are_the_first_of_the_scramble():
    import numpy as np

    for n, trials in ((3, 10), (100, 50), (2200, 300)):
        i, j = np.triu_indices(n, 1)
        order = np.lexsort((j, i, (i * 7919 + j * 104729) % 1000003))[:trials] if n * (n - 1) // 2 > trials else np.arange(len(i))
        got = ridges.trial_pairs(n, trials)
        assert (got[0] == i[order]).all() and (got[1] == j[order]).all()


def test_ransac_in_shares(spark, monkeypatch):
    """A ridge of four thousand plants, every tenth of them astray, compared in shares."""
    monkeypatch.setattr(ridges, "SHARE", 700)
    rows = [(1, i, 0, True, float(i), 9.0 if i % 10 == 0 else 0.1 * (i % 3)) for i in range(4000)]
    df = spark.createDataFrame(rows, "field_id long, fid long, ridge_id long, is_inlier boolean, along double, perp double")
    out = ridges.ransac_inliers(df, 0.35, 400).collect()
    assert len(out) == 4000 and all(r.is_inlier == (r.fid % 10 != 0) for r in out)
