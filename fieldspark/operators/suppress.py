"""Greedy suppression, and what is built on it: box merging and peak spacing.

A row is kept if no kept row of better rank conflicts with it. Conflicts never cross keys, so a key with at most ``AT_ONCE`` of
them is walked by rank in one task. Keys with more are parted into connected components of conflicts, which are walked
alike; only a component that is itself larger is decided in blocks of rank, each walked at once. Intermediate tables are
written to the shared folder, but for small tables.

Boxes in a crowd have conflicts with the square of their number, and these are never listed: of a crowded key the best ranks are
decided first, so few that their conflicts are some a box, and what they keep drops its neighbours among all others, of which each
meets a few kept boxes. What is left is asked again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoint import Scratch, written
from ..components import connected_components
from ..functions import geom
from ..numbering import row_numbers
from . import grids

BOX = ("gx0", "gy0", "gx1", "gy1")
#: Conflicts that one task walks at most; a few dozen bytes each.
AT_ONCE = 1_000_000
#: Rounds of peeling before blocks of rank.
PEELED = 4
#: Conflicts of a whole table that are walked without writing anything.
FEW = 20_000
#: Pairs of a key, and for each of its boxes, that are listed at once.
WHOLE, EACH = 50_000, 16
#: Shares of ranks that a block may have, as powers of a half.
HALVES = 24


def _walk(keys: list[str]):
    """Dropped rows among the conflicts of one group, by ascending rank; the last key is the rank."""
    better, worse = [f"{k}_a" for k in keys], [f"{k}_b" for k in keys]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(better[-1], kind="stable")
        gone, at = set(), []
        for k, (a, b) in enumerate(zip(rows[better].itertuples(index=False, name=None), rows[worse].itertuples(index=False, name=None), strict=True)):
            if a not in gone and b not in gone:
                gone.add(b)
                at.append(k)
        return rows.iloc[at][worse].set_axis(keys, axis=1)

    return run


def _named(rows: DataFrame, have: list[str], want: list[str]) -> DataFrame:
    return rows.select(*[F.col(h).alias(w) for h, w in zip(have, want, strict=True)])


def _huge(edges: DataFrame, keys: list[str], scratch: Scratch, at_once: int, max_rounds: int, schema: str) -> list[DataFrame]:
    """Dropped rows among conflicts (component, better.., worse..) of components that are too large for one walk.

    First a few rounds of peeling: a row that is no one's worse neighbour is kept, and its neighbours go, which settles most of what is not a
    long chain. Then by blocks of rank: the best ranks that have at_once conflicts among them are walked, and what they keep drops its
    neighbours beyond the block. So rounds follow the number of conflicts, not the length of chains.
    """
    better, worse = [f"{k}_a" for k in keys], [f"{k}_b" for k in keys]
    out = []

    def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
        for side in (better, worse):
            edges = edges.join(_named(gone, keys, side), side, "left_anti")
        return scratch.written(edges, "conflicts")

    for nth in range(max_rounds):
        if edges.isEmpty():
            return out
        if nth < PEELED:
            kept = _named(edges, better, keys).distinct().join(_named(edges, worse, keys).distinct(), keys, "left_anti")
            gone = _named(edges.join(_named(kept, keys, better), better, "left_semi"), worse, keys).distinct()
            gone = scratch.written(gone, "suppressed")
        else:
            most = edges.groupBy("component").count().agg(F.max("count")).first()[0]
            # The same share of each component, so the largest sets the number of blocks; without a limit all that is left is one block.
            limit = F.percentile_approx(worse[-1], at_once / most, 10_000) if most > at_once else F.max(F.lit(None).cast("long"))
            limits = scratch.written(edges.groupBy("component").agg(limit.alias("_t")), "limits")
            cut = edges.join(limits, "component").withColumn("_in", F.coalesce(F.col(worse[-1]) <= F.col("_t"), F.lit(True)))
            cut = scratch.written(cut.withColumn("_from", F.coalesce(F.col(better[-1]) <= F.col("_t"), F.lit(True))), "block")
            lost = cut.where("_in").select("component", *better, *worse).groupBy("component").applyInPandas(_walk(keys), schema)
            lost = scratch.written(lost, "suppressed")
            beyond = cut.where("_from and not _in").join(_named(lost, keys, better), better, "left_anti")
            gone = scratch.written(lost.unionByName(_named(beyond, worse, keys)).distinct(), "suppressed")
            edges = cut.where("not _from").select("component", *better, *worse)  # the block is decided
        out.append(gone)
        edges = without(edges, gone)
    raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")


def greedy_suppress(nodes: DataFrame, conflicts: DataFrame, keys: list[str], max_rounds: int = 10_000, at_once: int = AT_ONCE, few: int = FEW) -> DataFrame:
    """Kept rows of nodes(*keys), where the last key is the rank (smaller is better; ranks differ inside conflicts).

    conflicts(*keys with suffix _a, *keys with suffix _b): pairs of one key where a has the better rank. Raises RuntimeError after max_rounds.
    A walk by rank crosses keys without harm, as conflicts don't: up to few conflicts in all are walked in one list.
    """
    scratch = Scratch(nodes.sparkSession)
    better, worse = [f"{k}_a" for k in keys], [f"{k}_b" for k in keys]
    by = better[:-1]
    edges = conflicts.select(*better, *worse)
    schema = ", ".join(f"`{k}` {edges.schema[b].dataType.simpleString()}" for k, b in zip(keys, better, strict=True))
    if nodes.limit(10 * few + 1).count() <= 10 * few:  # larger tables are not asked for conflicts twice
        some = set(edges.limit(few + 1).collect())
        if len(some) <= few:
            # All there is fits a list: walked at once, without a table or a further job.
            rows = pd.DataFrame(list(some), columns=[*better, *worse], dtype=object)
            lost = list(_walk(keys)(rows).itertuples(index=False, name=None)) if some else []
            return nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(lost, schema)), keys, "left_anti")
    edges = scratch.written(edges.distinct(), "conflicts")
    large = edges.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > at_once).select(*by)
    small = edges.join(large, by, "left_anti")
    found = [small.groupBy(*by).applyInPandas(_walk(keys), schema)]
    if not large.isEmpty():
        rest = edges.join(large, by, "left_semi").withColumns({"a": F.xxhash64(*better), "b": F.xxhash64(*worse)})
        rest = scratch.written(rest, "rest")  # where two rows share a hash their components are one, which changes nothing
        part = connected_components(rest.select("a", "b"), scratch=scratch).withColumnRenamed("id", "a")
        rest = scratch.written(rest.join(part, "a"), "parted")
        huge = rest.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > at_once).select("component")
        found.append(rest.join(huge, "component", "left_anti").groupBy("component").applyInPandas(_walk(keys), schema))
        huge = scratch.written(rest.join(huge, "component", "left_semi").select("component", *better, *worse), "conflicts")
        found += _huge(huge, keys, scratch, at_once, max_rounds, schema)
    gone = found[0]
    for more in found[1:]:
        gone = gone.unionByName(more)
    gone = written(gone, "gone")
    scratch.drop()
    return nodes.join(gone, keys, "left_anti")


def ranked(detections: DataFrame, by: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Adds rank: by score descending, ties by (row, col, idx)."""
    numbered = row_numbers(detections, [F.desc("score"), "row", "col", "idx"], "rank", by, scratch=scratch)
    return numbered.withColumn("rank", F.col("rank").cast("int"))


def box_conflicts(boxes: DataFrame, overlap, limit: float, by: list[str], others: DataFrame | None = None) -> DataFrame:
    """Pairs of boxes of a key (or of boxes and others) whose overlap is over limit, the better ranked as _a. Boxes of any sizes meet through a hierarchy of grids."""
    sides = [rows.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in ("rank", *BOX)]) for s, rows in (("a", boxes), ("b", boxes if others is None else others))]
    names = [tuple(f"{c}_{s}" for c in BOX) for s in "ab"]
    pair = grids.box_pairs(*sides, by, *names).where("rank_a < rank_b")
    pair = pair.where(overlap(*[tuple(F.col(c) for c in box) for box in names]) > limit)
    return pair.select(*[F.col(k).alias(f"{k}_{s}") for s in "ab" for k in by], "rank_a", "rank_b")


def suppressed_boxes(boxes: DataFrame, overlap, limit: float, by: list[str]) -> DataFrame:
    """Kept boxes (by.., rank, gx0..gy1 and other columns): no kept box of better rank overlaps them over limit.

    A key whose cells bound its pairs by more than it may list at once is decided in blocks of rank. If a block leaves most of the boxes
    behind it, they conflict less than their cells suggest, and the next block is twice the share: so rounds are few for any boxes.
    """
    keys, scratch = [*by, "rank"], Scratch(boxes.sparkSession)
    left, kept, at_once = boxes, [], 1
    room = F.greatest(F.lit(WHOLE), EACH * F.col("n"))
    while True:
        crowded = scratch.written(grids.crowds(left, by, BOX).where(F.col("pairs") > room), "crowded")
        before = crowded.agg(F.sum("n")).first()[0]
        if before is None:
            break
        # Conflicts go with the square of the share of ranks.
        share = F.least(F.sqrt(at_once * F.least(room, F.lit(AT_ONCE)) / F.col("pairs")), F.lit(1.0))
        nth = F.least(F.ceil(-F.log2(share)).cast("int"), F.lit(HALVES)) + 1
        ends = F.percentile_approx("rank", F.array(*[F.lit(0.5**k) for k in range(HALVES + 1)]), F.lit(100_000)).alias("ends")
        some = left.join(crowded.select(*by), by, "left_semi").groupBy(*by).agg(ends).join(crowded, by)
        some = scratch.written(some.select(*by, F.element_at("ends", nth).alias("_end")), "ends")
        parted = scratch.written(left.join(some, by, "left"), "parted")
        block, rest = parted.where("rank <= _end").drop("_end"), parted.where("rank > _end").drop("_end")
        best = scratch.written(greedy_suppress(block, box_conflicts(block, overlap, limit, by), keys), "best")
        gone = _named(box_conflicts(best, overlap, limit, by, rest), [f"{k}_b" for k in keys], keys).distinct()
        rest = scratch.written(rest.join(gone, keys, "left_anti"), "rest")
        kept.append(best)
        if rest.count() > 0.75 * before:
            at_once *= 4
        left = scratch.written(rest.unionByName(parted.where("_end is null").drop("_end")), "left")
    left = greedy_suppress(left, box_conflicts(left, overlap, limit, by), keys)
    if kept:
        for more in kept:
            left = left.unionByName(more)
        left = written(left, "kept")
    scratch.drop()
    return left


def nms(detections: DataFrame, iou: float = 0.5, ios: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Kept detections with their rank: boxes over iou with a better kept box go, then among the rest those over ios.

    detections: by.., row, col, idx, gx0, gy0, gx1, gy1, score. A null score counts as 1.0.
    """
    by = by or ["raster_id"]
    scratch = Scratch(detections.sparkSession)
    kept = written(ranked(detections.withColumn("score", F.coalesce("score", F.lit(1.0))), by, scratch), "ranked")
    scratch.drop()
    for overlap, limit in ((geom.iou, iou), (geom.ios, ios)):
        if limit is not None:
            kept = suppressed_boxes(kept, overlap, limit, by)
    return kept


def merge_detections(
    detections: DataFrame, iou: float = 0.5, ios: float = 0.95, remove_boundary: bool = True, remove_overlay: bool = True, border: float = 2.0, by: list[str] | None = None
) -> DataFrame:
    """Detections of all slices merged: border filter, suppression, centres cx, cy and a polygon for each kept box.

    Columns px0..py1, slice_w, slice_h, edge and polygon are optional; without them nothing is near a border and
    the box is the polygon.
    """
    rows = detections
    have = set(rows.columns)
    if remove_boundary and {"px0", "py0", "px1", "py1", "slice_w", "slice_h", "edge"} <= have:
        rows = rows.where(geom.inside_border(*[F.col(c) for c in ("px0", "py0", "px1", "py1", "slice_w", "slice_h")], F.col("edge"), border))
    kept = nms(rows, iou, ios if remove_overlay else None, by)
    box = [F.col(c) for c in BOX]
    cx, cy = geom.box_center(*box)
    ring = geom.box_ring(*box)
    return kept.withColumns({"cx": cx, "cy": cy, "polygon": F.coalesce("polygon", ring) if "polygon" in have else ring})


def export_frames(merged: DataFrame, source: str = "model", by: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes, points, polygons) of a merged table; fid counts from 0 in order of rank."""
    by = by or ["raster_id"]
    rows = row_numbers(merged, ["rank"], "fid", by, first=0)
    boxes = rows.select(*by, "fid", F.col("gx0").alias("xmin"), F.col("gy0").alias("ymin"), F.col("gx1").alias("xmax"), F.col("gy1").alias("ymax"), "score")
    points = rows.select(*by, "fid", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(source).alias("source"), F.col("score").alias("conf"))
    polygons = rows.select(*by, "fid", "score", geom.close_ring(F.col("polygon")).alias("polygon"))
    return boxes, points, polygons


def spaced_peaks(peaks: DataFrame, distance: Column, by: list[str]) -> DataFrame:
    """Peaks (by.., bin, n) of which no higher kept one is nearer than distance bins; on equal height the greater bin wins."""
    rows = written(peaks.withColumn("distance", distance.cast("long")).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), F.desc("bin")))), "peaks")
    # Bins closer than the distance lie in the same or the next block of that width.
    block = F.floor(F.col("bin") / F.col("distance"))
    a = rows.select(*by, F.explode(F.array(block - 1, block, block + 1)).alias("block"), F.col("bin").alias("bin_a"), F.col("rank").alias("rank_a"), "distance")
    b = rows.select(*by, block.alias("block"), F.col("bin").alias("bin_b"), F.col("rank").alias("rank_b"))
    pair = a.join(b, [*by, "block"]).where((F.col("rank_a") < F.col("rank_b")) & (F.abs(F.col("bin_a") - F.col("bin_b")) < F.col("distance")))
    pair = pair.select(*[F.col(k).alias(f"{k}_{s}") for s in "ab" for k in by], "rank_a", "rank_b")
    return greedy_suppress(rows, pair, [*by, "rank"]).drop("rank", "distance")
