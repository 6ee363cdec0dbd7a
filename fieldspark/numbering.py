"""Row numbers and running sums along an order, in two levels, so that no key and no table is one task.

Rows are range-partitioned by key and order and written once with their place. A key that spans several
ranges is added up over the small table of its ranges; rows are numbered within their range only. What
is broadcast has at most one row a range, as a range begins inside at most one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checkpoint import Scratch, written


def _free(df: DataFrame, name: str, out: str) -> str:
    """A name that neither df nor the result's column has."""
    have = {c.lower() for c in (*df.columns, out)}
    while name.lower() in have:
        name = "_" + name
    return name


def _ranged(rows: DataFrame, order: list, out: str, by: list[str], scratch: Scratch | None, parts: int | None) -> tuple[DataFrame, str]:
    """rows in ranges of (by, order), written, with a column that grows along the order; its upper bits are the range."""
    place = _free(rows, "place", out)
    how = [F.col(c).asc_nulls_first() for c in by] + [c if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in order]
    ranged = rows.repartitionByRange(*([parts] if parts else []), *how).sortWithinPartitions(*how)
    ranged = ranged.withColumn(place, F.monotonically_increasing_id())
    return (scratch.written if scratch else written)(ranged, "ranged"), place


def _added(rows: DataFrame, order: list, value: Column, out: str, by: list[str], inclusive: bool, scratch: Scratch | None, parts: int | None) -> DataFrame:
    ranged, place = _ranged(rows, order, out, by, scratch, parts)
    part, before = _free(ranged, "part", out), _free(ranged, "before", out)
    ranged = ranged.withColumn(part, F.shiftright(place, 33).cast("int"))
    sums = ranged.groupBy(*by, part).agg(F.sum(value).alias(before))
    own = W.partitionBy(*by).orderBy(part)
    # Keys of one range have nothing before them; a range begins inside one key at most.
    sums = sums.withColumn(before, F.sum(before).over(own.rowsBetween(W.unboundedPreceding, -1))).where(F.col(before).isNotNull())
    names = [_free(ranged, f"key{i}", out) for i in range(len(by))]
    key_part = _free(ranged, "key_part", out)
    sums = sums.select(*[F.col(c).alias(name) for c, name in zip(by, names, strict=True)], F.col(part).alias(key_part), before)
    here = ranged[part] == sums[key_part]
    for c, name in zip(by, names, strict=True):
        here = here & ranged[c].eqNullSafe(sums[name])
    inside = W.partitionBy(*by, part).orderBy(place).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    joined = ranged.withColumn(out, local).join(F.broadcast(sums), here, "left")
    return joined.select(*rows.columns, (F.col(out) + F.coalesce(F.col(before), F.lit(0))).alias(out))


def row_numbers(
    rows: DataFrame, order: list, out: str, by: list[str] | None = None, first: int = 1, scratch: Scratch | None = None, parts: int | None = None
) -> DataFrame:
    """rows with out, a long that counts from first along order (names or sort expressions) within by; null keys are a key.

    order should tell rows apart, or reruns may number ties otherwise; rows of one order value stay in one
    range. An empty table stays empty. The written rows go with scratch, or stay in the shared folder.
    """
    numbered = _added(rows, order, F.lit(1).cast("long"), out, by or [], True, scratch, parts)
    return numbered.withColumn(out, F.col(out) + F.lit(first - 1)) if first != 1 else numbered


def running_sum(
    rows: DataFrame, order: list, value: str, out: str, by: list[str] | None = None, inclusive: bool = False, scratch: Scratch | None = None, parts: int | None = None
) -> DataFrame:
    """rows with out, the sum of value before each row (up to it, if inclusive) along order within by. Nulls count as 0."""
    return _added(rows, order, F.coalesce(F.col(value), F.lit(0)), out, by or [], inclusive, scratch, parts)
