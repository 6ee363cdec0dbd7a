"""Map projections: known places, round trips over whole zones, codes."""

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import geom
from fieldspark.functions import projections as pj


def place(spark, lon, lat, src, dst):
    x, y = pj.reproject(F.lit(lon), F.lit(lat), src, dst)
    return tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first())


def test_known_places(spark):
    assert place(spark, 151.2093, -33.8688, "EPSG:4326", "EPSG:32756") == pytest.approx((334368.6336, 6250948.3454), abs=1e-3)
    assert place(spark, 15.0, 0.0, "EPSG:4326", "EPSG:32633") == pytest.approx((500_000, 0), abs=1e-6)
    assert place(spark, 117.0, 0.0, "EPSG:4490", "EPSG:4548") == pytest.approx((500_000, 0), abs=1e-6)
    # A quarter of the meridian, times the scale on it.
    assert place(spark, 15.0, 90.0, "EPSG:4326", "EPSG:32633")[1] == pytest.approx(10_001_965.7293 * 0.9996, abs=1e-3)


@pytest.mark.parametrize("code", ["EPSG:32601", "EPSG:32660", "EPSG:32733", "epsg:25832", "EPSG:26918", "EPSG:4491", "EPSG:4546"])
def test_round_trip_over_a_whole_zone(spark, code):
    t = pj.projection(code)
    rows = spark.range(20_000).select((t.central - 3.5 + 7 * F.rand(1)).alias("lon"), (168 * F.rand(2) - 84).alias("lat"))
    x, y = pj.reproject(F.col("lon"), F.col("lat"), "EPSG:4326", code)
    back = rows.select("lon", "lat", x.alias("x"), y.alias("y")).withColumns(dict(zip(("u", "v"), pj.reproject(F.col("x"), F.col("y"), code, "EPSG:4326"), strict=True)))
    again = back.withColumns(dict(zip(("x2", "y2"), pj.reproject(F.col("u"), F.col("v"), "EPSG:4326", code), strict=True)))
    off = again.agg(*[F.max(F.abs(F.col(a) - F.col(b))) for a, b in (("x", "x2"), ("y", "y2"), ("lon", "u"), ("lat", "v"))]).first()
    assert max(off[0], off[1]) < 1e-6 and max(off[2], off[3]) < 1e-11


def test_between_zones_hemispheres_and_web_mercator(spark):
    x, y = place(spark, 18.2, 50.0, "EPSG:4326", "EPSG:32633")
    assert place(spark, x, y, "EPSG:32633", "EPSG:32634") == pytest.approx(place(spark, 18.2, 50.0, "EPSG:4326", "EPSG:32634"), abs=1e-6)
    assert place(spark, x, y, "EPSG:32633", "EPSG:32733") == pytest.approx((x, y + 10_000_000), abs=1e-6)
    assert place(spark, x, y, "EPSG:32633", "EPSG:3857") == pytest.approx(place(spark, 18.2, 50.0, "EPSG:4326", "EPSG:3857"), abs=1e-6)
    ring = F.array(geom.point(F.lit(x), F.lit(y)), geom.point(F.lit(x + 1), F.lit(y)))
    out = spark.range(1).select(geom.reproject_polygon(ring, "EPSG:32633", "EPSG:32634").alias("r")).first().r
    assert tuple(out[0]) == pytest.approx(place(spark, x, y, "EPSG:32633", "EPSG:32634"), abs=1e-9)


def test_unknown_codes_and_own_systems(spark):
    for bad in ("EPSG:1", "EPSG:32661", "EPSG:32700", "EPSG:2154", "WGS84", ""):
        with pytest.raises(ValueError, match="closed form"):
            pj.projection(bad)
    own = pj.TransverseMercator(-2.0, 0.9996012717, 400_000.0, -100_000.0)
    x, y = place(spark, -2.0, 51.0, "EPSG:4326", own)
    assert x == pytest.approx(400_000) and place(spark, x, y, own, "EPSG:4326") == pytest.approx((-2.0, 51.0))
    assert place(spark, None, 1.0, "EPSG:4326", "EPSG:32633") == (None, None)
    assert place(spark, 3.0, 4.0, "EPSG:4326", "EPSG:4258") == (3.0, 4.0)


def test_zone_and_unit(spark):
    row = spark.range(1).select(
        pj.zone_of(F.lit(15.1), F.lit(-3.0)).alias("a"), pj.zone_of(F.lit(180.0), F.lit(3.0)).alias("b"), pj.zone_of(F.lit(-180.0), F.lit(0.0)).alias("c"),
        *[geom.unit_of_crs(F.lit(c)).alias(c[5:]) for c in ("EPSG:32633", "epsg:4490", "EPSG:4548", "EPSG:99")],
    ).first()
    assert tuple(row) == ("EPSG:32733", "EPSG:32660", "EPSG:32601", "m", "deg", "m", "unit")
