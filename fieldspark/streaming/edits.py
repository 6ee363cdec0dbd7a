"""Replay of point edits with undo, and debouncing of parameter changes; as a batch or as a stream.

edits: field_id, seq, action (add, move, delete, undo), fid, x, y. add takes the next number of its field, which is never
used again, not even after undo; move and delete of an unknown point do nothing and cannot be undone; undo takes back the
latest edit that is not undone, and does nothing if there is none.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Replay:
    """Points and undo stack of one field: any mapping of numbers to places, and anything with append, pop and a length."""

    def __init__(self, points: Any = None, stack: Any = None, following: int = 0, max_undo: int | None = None):
        self.points, self.following = {} if points is None else points, following
        self.stack = deque(maxlen=max_undo) if stack is None else stack

    def apply(self, action: str, fid: int | None, x: float | None, y: float | None) -> None:
        if action == "add":
            self.points[self.following] = (x, y)
            self.stack.append(("add", self.following, None))
            self.following += 1
        elif action == "undo":
            if len(self.stack):
                did, of, old = self.stack.pop()
                if did == "add":
                    self.points.pop(of, None)
                else:
                    self.points[of] = old
        elif fid in self.points:
            self.stack.append((action, fid, self.points[fid]))
            if action == "move":
                self.points[fid] = (x, y)
            elif action == "delete":
                self.points.pop(fid)


def replay(edits: DataFrame, by: str = "field_id", max_undo: int | None = None) -> DataFrame:
    """(by, fid, x, y) after all edits of each key in order of seq. A key's edits are read in batches, in sorted order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Replay(max_undo=max_undo)

        def out() -> pd.DataFrame:
            rows = [(key, f, x, y) for f, (x, y) in sorted(state.points.items())]
            return pd.DataFrame(rows, columns=[by, "fid", "x", "y"]).astype({"fid": "int64"})

        for batch in batches:
            for k, action, fid, x, y in batch[[by, "action", "fid", "x", "y"]].itertuples(index=False, name=None):
                if k != key:
                    if key is not None:
                        yield out()
                    key, state = k, Replay(max_undo=max_undo)
                state.apply(action, None if pd.isna(fid) else int(fid), x, y)
        if key is not None:
            yield out()

    kind = edits.schema[by].dataType.simpleString()
    rows = edits.where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, "seq").select(by, "seq", "action", "fid", "x", "y")
    return rows.mapInPandas(run, f"{by} {kind}, fid long, x double, y double")


class _Points:
    """Points of a field in keyed state: read when an edit names them, written back only if they changed."""

    def __init__(self, state: Any):
        self.state, self.read, self.now = state, {}, {}

    def _at(self, fid: int) -> tuple | None:
        if fid not in self.now:
            self.read[fid] = self.now[fid] = self.state.getValue((fid,)) if self.state.containsKey((fid,)) else None
        return self.now[fid]

    def __contains__(self, fid: int | None) -> bool:
        return fid is not None and self._at(fid) is not None

    def __getitem__(self, fid: int) -> tuple:
        return self._at(fid)

    def __setitem__(self, fid: int, place: tuple) -> None:
        self._at(fid)
        self.now[fid] = place

    def pop(self, fid: int, default: Any = None) -> None:
        self._at(fid)
        self.now[fid] = None

    def written(self) -> dict[int, tuple | None]:
        """Writes what changed, and returns it; a deleted point is None."""
        changed = {f: p for f, p in self.now.items() if p != self.read[f]}
        for fid, place in changed.items():
            if place is None:
                self.state.removeKey((fid,))
            else:
                self.state.updateValue((fid,), place)
        return changed


class _Stack:
    """Undo steps in keyed state by depth: the top is read when it is undone, new steps are written once."""

    def __init__(self, state: Any, bottom: int, top: int, max_undo: int | None):
        self.state, self.bottom, self.top, self.max_undo = state, bottom, top, max_undo
        self.was, self.new = (bottom, top), []

    def __len__(self) -> int:
        return self.top + len(self.new) - self.bottom

    def append(self, step: tuple) -> None:
        self.new.append(step)
        if self.max_undo is not None and len(self) > self.max_undo:
            self.bottom += 1

    def pop(self) -> tuple:
        if self.new:
            return self.new.pop()
        self.top -= 1
        did, fid, x, y = self.state.getValue((self.top,))
        return did, fid, None if did == "add" else (x, y)

    def written(self) -> tuple[int, int]:
        end = self.top + len(self.new)
        for depth in range(max(self.top, self.bottom), end):
            did, fid, old = self.new[depth - self.top]
            self.state.updateValue((depth,), (did, fid, *(old or (None, None))))
        for depth in (*range(self.was[0], min(self.bottom, self.was[1])), *range(max(end, self.was[0]), self.was[1])):
            self.state.removeKey((depth,))
        return self.bottom, end


class _Field(StatefulProcessor):
    """State of a field: a point an entry, an undo step an entry, and counters. Edits up to the last seq are late and only counted."""

    def __init__(self, by: str, max_undo: int | None, only_changes: bool):
        self.by, self.max_undo, self.only_changes = by, max_undo, only_changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "fid bigint", "x double, y double")
        self.steps = handle.getMapState("steps", "depth bigint", "did string, fid bigint, x double, y double")
        self.counters = handle.getValueState("counters", "following bigint, seq bigint, late bigint, bottom bigint, top bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        following, seq, late, bottom, top = self.counters.get() if self.counters.exists() else (0, None, 0, 0, 0)
        points, stack = _Points(self.points), _Stack(self.steps, bottom, top, self.max_undo)
        field = Replay(points, stack, following)
        edits = pd.concat(list(rows)).sort_values("seq")
        for number, action, fid, x, y in edits[["seq", "action", "fid", "x", "y"]].itertuples(index=False, name=None):
            if seq is not None and number <= seq:
                late += 1
                continue
            field.apply(action, None if pd.isna(fid) else int(fid), x, y)
            seq = int(number)
        changed, (bottom, top) = points.written(), stack.written()
        self.counters.update((field.following, seq, late, bottom, top))
        if self.only_changes:
            found = sorted(changed.items())
        else:
            found = sorted((k[0], tuple(v)) for k, v in self.points.iterator())
        x, y = ([None if p is None else p[i] for _, p in found] for i in (0, 1))
        out = {self.by: [key[0]] * len(found), "fid": [f for f, _ in found], "x": x, "y": y, "seq": [seq] * len(found)}
        if self.only_changes:
            out["alive"] = [p is not None for _, p in found]
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def replay_stream(edits: DataFrame, by: str = "field_id", max_undo: int | None = None, only_changes: bool = False) -> DataFrame:
    """For each micro-batch the points (by, fid, x, y, seq) of every field that it edits, after it; needs the RocksDB state store.

    With only_changes just the points that the batch changed, with alive: false for those that went. State is kept by point and by
    undo step, so what a batch reads and writes follows its edits, not the size of the field. Undo reaches back without a bound unless max_undo is given, as in
    replay().
    """
    kind = edits.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, fid long, x double, y double, seq long" + ", alive boolean" * only_changes
    return edits.groupBy(by).transformWithStateInPandas(_Field(by, max_undo, only_changes), schema, "Update", "None")


def debounce(changes: DataFrame, gap: str = "800 milliseconds", watermark: str | None = None, by: str = "key") -> DataFrame:
    """(by, start, end, value, n): one row for each burst of changes (by, ts, seq, value); the last value counts. On a stream give a watermark."""
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else changes
    out = rows.groupBy(by, F.session_window("ts", gap).alias("burst")).agg(F.max_by("value", F.struct("ts", "seq")).alias("value"), F.count("*").alias("n"))
    return out.select(by, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "value", "n")
