"""Connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import Scratch, written


def connected_components(links: DataFrame, max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every id in links(a, b): component is the smallest id that can be reached.

    Alternating large-star and small-star rounds: every neighbour is re-linked to the
    smallest id that its neighbour sees, so stars of any size stay partial
    aggregates and two-column joins. Each round is written to the shared folder.
    Empty links give an empty table. Raises if max_rounds do not suffice.
    """
    write = scratch.written if scratch else written
    edges = write(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = write(
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct(),
            "links",
        )
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
