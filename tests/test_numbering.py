"""Numbers and running sums in ranges, against plain windows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark import numbering


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_numbers_equal_a_window(spark, parts):
    rows = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40)).alias("part"), F.hash("id").alias("place"), F.col("id").alias("v"), F.lit("x").alias("before"))
    for order, how in ((["place", "v"], [F.col("place"), F.col("v")]), ([F.col("place").desc(), "v"], [F.col("place").desc(), F.col("v")])):
        got = numbering.row_numbers(rows, order, "n", ["part"], first=0, parts=parts)
        assert got.columns == ["part", "place", "v", "before", "n"] and got.schema["n"].dataType.simpleString() == "bigint"
        want = rows.withColumn("n", F.row_number().over(W.partitionBy("part").orderBy(*how)) - 1)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = numbering.running_sum(rows.drop("before"), ["place", "v"], "v", "before", parts=parts).withColumnRenamed("before", "s").withColumn("before", F.lit("x")).select("part", "place", "v", "before", "s")
    want = rows.withColumn("s", F.coalesce(F.sum("v").over(W.orderBy("place", "v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_and_ties(spark):
    assert numbering.row_numbers(spark.createDataFrame([], "k int, v int"), ["v"], "n", ["k"]).count() == 0
    rows = spark.createDataFrame([(1, 5)] * 9, "k int, v int")
    assert sorted(r.n for r in numbering.row_numbers(rows, ["v"], "n", ["k"]).collect()) == list(range(1, 10))
