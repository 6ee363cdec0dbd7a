"""Names of working columns, and what the corpus operators share with the rest of the library."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..checkpoint import Scratch, shared_folder, written
from ..components import connected_components

__all__ = ["Scratch", "connected_components", "shared_folder", "small_batches", "unused", "written"]

#: Bytes of an Arrow batch inside small_batches().
BATCH = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, so that extra columns never clash."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send rows to Python in batches of ``BATCH`` bytes at most (a longer row is one by itself); a smaller limit of the session stays.

    Otherwise 10,000 texts are one batch, up to 64 MB, which a task holds twice on either side.
    """
    before = spark.conf.get(_BYTES, None)
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) if before else -1
    if 0 < limit <= BATCH:
        yield
        return
    spark.conf.set(_BYTES, str(BATCH))
    try:
        yield
    finally:
        if before:
            spark.conf.set(_BYTES, before)
        else:
            spark.conf.unset(_BYTES)
