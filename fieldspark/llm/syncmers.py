"""Document fingerprints of closed syncmers, for positional matching.

Method. A k-mer of a text's bytes (k = 24) is a closed syncmer if the least of its s-mers (s = 8),
by a hash, is its first or its last. Whether a k-mer is chosen depends on its own bytes
alone, so an edit only changes anchors that it touches. A fingerprint keeps every anchor of the whole text
with each place where it stands, so it grows with the text: eight hexadecimal digits of hash, eight of
place, in order of hash, then place.

Short texts hold few such k-mers, so texts under 256 bytes also have anchors of k = 6, s = 2, and those under 32 bytes of
k = 2, s = 1, in levels of their own (the two highest bits of a place); a likeness is that of the finest level both texts have.

Likeness. The shift of two texts is the median over the hashes they share, by their first places. An anchor
is matched if the other text has one of its hash at its place moved by about that shift. The likeness is the share of
matched anchors among those of both texts: 1 for equal fingerprints, 0 without a common anchor.

The edited text of a document ends with the beginning of the next document. Documents are
dealt by ranges of ids in one exchange; the first document of each range is also sent to the
range before, so no task sees more than its range and nothing is joined.

Edge cases. A null or empty text has an empty fingerprint; a text without an anchor (one byte) has one mark for its
whole content, so equal texts have equal fingerprints. Order is by id (nulls first), then text,
so rows that repeat an id have a defined next row; the row after the last is the first, which for a
table of one row is itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

K, S, SLACK = 24, 8, 64
#: k, s and the bytes under which a text has anchors of the level.
LEVELS = ((K, S, 1 << 62), (6, 2, 256), (2, 1, 32))
PLACE = np.uint64((1 << 30) - 1)


def anchors(data: np.ndarray, at: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every closed syncmer of the given texts, in order of place."""
    run = tb.prefix_hash(data)
    inner = tb.window_hash(run, s)
    least = tb.sliding_min(inner, k - s + 1)
    n = len(least)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    end = at[np.searchsorted(at, place, "right")]
    place = place[place + k <= end]
    return place, tb.span_hash(run, place, place + k)


def sketches(texts: pa.Array) -> list[np.ndarray]:
    """For each text an array (hash, place) of all its anchors, sorted."""
    out: list[np.ndarray] = []
    for lo, hi, data, at in tb.chunks(texts):
        levels = []
        for level, (k, inner, most) in enumerate(LEVELS):
            if level and not (np.diff(at) < most).any():
                break
            place, key = anchors(data, at, k, inner)
            levels.append((level, most, place, key, np.searchsorted(place, at)))
        for i in range(hi - lo):
            size = at[i + 1] - at[i]
            rows = []
            for level, most, place, key, bound in levels:
                a, b = bound[i], bound[i + 1]
                if b > a and size < most:
                    where = (place[a:b] - at[i]).astype(np.uint64) & PLACE
                    rows.append((key[a:b] >> np.uint64(32)) << np.uint64(32) | np.uint64(level << 30) | where)
            if rows:
                out.append(np.sort(np.concatenate(rows)).astype(">u8").view(">u4").reshape(-1, 2))
            elif size:
                whole = hashlib.sha256(data[at[i] : at[i + 1]].tobytes()).digest()
                out.append(np.array([[int.from_bytes(whole[:4], "big"), 0xFFFFFFFF]], ">u4"))
            else:
                out.append(np.zeros((0, 2), ">u4"))
    return out


def _matched(x: np.ndarray, y: np.ndarray, moved: int) -> int:
    """How many rows of x = (number of hash, place) have one of the same hash in y near their place moved."""
    step = np.int64(1 << 34)
    have = y[:, 0] * step + y[:, 1]
    aim = x[:, 1] + moved
    slack = SLACK + np.maximum(x[:, 1], aim) // 16
    least = x[:, 0] * step + np.clip(aim - slack, 0, step - 1)
    most = x[:, 0] * step + np.clip(aim + slack, -1, step - 1)
    return int((np.searchsorted(have, least) < np.searchsorted(have, most, "right")).sum())


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Of two fingerprints, from 0 to 1."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    of_x, of_y = x[:, 1] >> 30, y[:, 1] >> 30
    level = next((v for v in (2, 1, 0, 3) if (of_x == v).any() and (of_y == v).any()), None)
    if level is None:
        return 0.0
    x, y = x[of_x == level], y[of_y == level]
    common, i, j = np.intersect1d(x[:, 0], y[:, 0], return_indices=True)  # first places, as rows are sorted
    if not len(common):
        return 0.0
    moved = int(np.median(y[j, 1].astype(np.int64) - x[i, 1].astype(np.int64)))
    rows = []
    for z in (x, y):
        z = z[np.isin(z[:, 0], common)]
        rows.append(np.stack([np.searchsorted(common, z[:, 0]), z[:, 1].astype(np.int64)], 1))
    return (_matched(*rows, moved) + _matched(*rows[::-1], -moved)) / (len(x) + len(y))


def _deal(bounds: np.ndarray):
    """Each row to its range of ids, and the first rows of a range also to the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            null = np.asarray(ids.is_null())
            own = np.where(null, bounds[0], ids.fill_null(int(bounds[0])).to_numpy(zero_copy_only=False))
            bucket = np.maximum(np.searchsorted(bounds, own, "right") - 1, 0)
            every = np.arange(len(own))
            first = np.flatnonzero((own == bounds[bucket]) | null)  # nulls sort before all, so they begin the first range
            rows = np.r_[every, first]
            to = np.r_[bucket, (bucket[first] - 1) % len(bounds)].astype(np.int32)
            tail = np.r_[np.zeros(len(every), bool), np.ones(len(first), bool)]
            for lo in range(0, len(rows), 2000):
                part = batch.take(pa.array(rows[lo : lo + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(to[lo : lo + 2000]), pa.array(tail[lo : lo + 2000]), *part.columns], names=["bucket", "tail", "id", "text"])

    return run


def edited(text: str, following: str) -> str:
    """text with its last quarter of characters replaced by as many from the front of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row so far: bucket, tail, id, text, sketch
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            bucket, tail, ids, texts = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            marks = sketches(pa.array(texts, pa.string()))
            rows = [*([held] if held else []), *zip(bucket, tail, ids, texts, marks, strict=True)]
            held = rows[-1]
            done = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
            changed = [edited(a[3], b[3]) for a, b in done]
            new = sketches(pa.array(changed, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in done], pa.int64()),
                    pa.array([len(a[3]) for a, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([a[4].tobytes().hex() for a, _ in done], pa.string()),
                    pa.array([m.tobytes().hex() for m in new], pa.string()),
                    pa.array([likeness(a[4], m) for (a, _), m in zip(done, new, strict=True)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in done], pa.float64()),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    n = 4 * parts
    cuts = own.agg(F.min("id").alias("least"), F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()
    bounds = np.array(sorted({cuts["least"] or 0, *(cuts["cuts"] or ())}), np.int64)
    dealt = own.mapInArrow(_deal(bounds), "bucket int, tail boolean, id long, text string")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "id", "text")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compare, schema).withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row of docs; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes().hex() for m in sketches(batch.column(1))], pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")
    return out.withColumnRenamed("id", id_col)
