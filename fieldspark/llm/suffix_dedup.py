"""Exact substring de-duplication: every passage stays only in the document with the smallest id.

A byte goes if a string of ``length`` bytes (50) that covers it also starts in a document with
a smaller id; strings never cross documents and are judged on the input.

Method. The windows of ``length`` bytes are the documents of a collection whose suffix order
is built column by column: each round inserts one more symbol, from the right, in
front of every window's suffix. The symbols that are inserted, listed in the order of the
suffixes so far, are that round's segment of the collection's Burrows-Wheeler transform; a
stable distribution of the order by symbol (its LF mapping) is the next order, and
neighbours still share a common prefix of the round's depth if symbol and earlier prefix are both
shared. After the last round neighbours that share a prefix of full depth are equal
windows, and the least id among them decides. All windows end in the last round, so
the transform needs no merge of suffixes of different lengths. What stands of the method and what does not: columns with their
segments, orders and common prefixes are files of the task, which each round passes through in sequence and in blocks: one pass
writes the segment, the next reads it and lays order and prefixes of the next round down, symbol by symbol. In
memory are one column (a byte a window) and, at the end, the last order. The prefix is kept as the number of the class
that shares the round's full depth, not as a length. Which windows meet in a task is settled by minimizers, before the method begins.

Spark deals the work out and keeps it small. Consecutive windows with one minimizer (the least hash
of their 24-byte strings) are one piece. (1) Minimizers are exchanged in packed blocks
to find those that at least two documents hold. (2) Only pieces with such a
minimizer go on, dealt by minimizer, so that equal windows meet; where a minimizer is
in very many documents its windows are dealt by their own hash instead, so a common line
with many contexts is split. Whole copies are cut first, and equal pieces of a task
are merged to one with its least and greatest id before they are dealt. (3) Each occurrence of a piece looks up the least ids of
its windows by a join, and documents cut out what is covered.

Edge cases. A null or empty text has no bytes. A text shorter than ``length`` keeps all.
A document with a null id neither loses bytes nor takes them from others.
Rows that repeat an id and text get equal results; where one id has different texts, each loses its own
spans, and none for what another text of its id holds. Extra columns are ignored by ``spans`` and kept by ``cut``.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import Scratch, unused

LENGTH, GRAM, LONGEST_PIECE, COMMON, BLOCK = 50, 24, 64, 4096, 1 << 20
RUN = np.dtype([("n", "u1"), ("doc", "<i8")])


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary value for each row, of so many of the values."""
    ends = np.r_[0, np.cumsum(counts)].astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def pieces(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, windows, hash of minimizer) of the pieces of the given texts."""
    run = tb.prefix_hash(data)
    least = tb.sliding_min(tb.window_hash(run, gram), length - gram + 1)
    n = len(least)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.zeros(len(data) + 2, np.int8)
    long = np.diff(at) >= length
    edge[at[:-1][long]] += 1
    edge[at[1:][long] - length + 1] -= 1
    inside = np.cumsum(edge[:n], dtype=np.int8) > 0
    same = np.zeros(n, bool)
    same[1:] = inside[:-1] & (least[1:] == least[:-1])
    first = np.flatnonzero(inside & ~same)
    stop = np.zeros(n + 1, bool)
    stop[first] = True
    stop[1:][inside & np.r_[~inside[1:], True]] = True
    bounds = np.flatnonzero(stop)
    count = bounds[np.searchsorted(bounds, first, "right")] - first
    if len(count) and count.max() > LONGEST_PIECE:
        more = -(-count // LONGEST_PIECE)
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        left = np.repeat(count, more) - nth * LONGEST_PIECE
        first, count = np.repeat(first, more) + nth * LONGEST_PIECE, np.minimum(left, LONGEST_PIECE)
    return first, count, tb.mix(least[first])


def keys(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for each span, as two."""
    return tb.span_hash(tb.prefix_hash(data), first, end), tb.span_hash(tb.prefix_hash(255 - data), first, end)


def _minimizers(parts: int):
    """Packed (minimizer, document) blocks for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = np.where(np.isnan(ids), -1, ids).astype(np.int64) if ids.dtype.kind == "f" else ids
            null = np.asarray(batch.column(0).is_null())
            every, doc = [], []
            for lo, _, data, at in tb.chunks(batch.column(1)):
                first, _, key = pieces(data, at)
                row = np.searchsorted(at, first, "right") - 1 + lo
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][: len(key)] & ~null[row]
                every.append(key[new])
                doc.append(row[new])
            key, row = np.concatenate(every or [np.zeros(0, np.uint64)]), np.concatenate(doc or [np.zeros(0, np.int64)])
            if not len(key):
                continue
            bucket = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((row, bucket))
            bucket, value, own = bucket[order], (key[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), ids[row[order]]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            count = np.diff(np.r_[start, len(bucket)])
            least = np.minimum.reduceat(own, start)
            far = own - np.repeat(least, count)
            far = far.astype("<u4" if far.max() < 1 << 32 else "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[start]), pa.array(least), packed(value, count), packed(far, count)], names=["bucket", "least", "value", "doc"]
            )

    return run


def _held_twice(common: int):
    """For each document its minimizers that another document holds: 30 bits of hash and two marks.

    Mark 1: a document of smaller id holds it. Mark 2: very many documents hold it.
    """

    def run(table: pa.Table) -> pa.Table:
        values, docs = [], []
        for least, value, doc in zip(table["least"].to_pylist(), table["value"], table["doc"], strict=True):
            v, d = value.as_buffer(), doc.as_buffer()
            values.append(np.frombuffer(v, "<u4"))
            docs.append(np.frombuffer(d, "<u4" if len(d) == len(v) else "<i8").astype(np.int64) + least)
        value, doc = np.concatenate(values), np.concatenate(docs)
        order = np.argsort(value >> 2, kind="stable")
        value, doc = value[order], doc[order]
        start = np.flatnonzero(np.r_[True, (value[1:] ^ value[:-1]) > 3])
        count = np.diff(np.r_[start, len(value)])
        shared = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
        least = np.repeat(np.minimum.reduceat(doc, start), count)
        keep, many = np.repeat(shared, count), np.repeat(count >= common, count)
        kind = (2 * many + (doc > least))[keep]
        value, doc = value[keep], doc[keep]
        marks = (value & ~np.uint32(3)) | kind.astype(np.uint32)
        return pa.table({"id": doc, "mark": marks.view(np.int32)})

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each 32-bit value in an array<int> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    return rows, column.flatten().to_numpy(zero_copy_only=False).view(np.uint32)


def _found(batch: pa.RecordBatch, later: bool):
    """Pieces of a batch (id, text, marks) whose minimizer is marked, or only those that a smaller id holds too.

    Row, first byte in the batch, windows, hash to deal by, bytes of all texts and their offsets.
    """
    data, at = tb.utf8(batch.column(1))
    own, mark = _flat(batch.column(2))
    use = (mark & 1 == 1) | (not later)
    own = own.astype(np.uint64) << np.uint64(32) | (mark >> 2)
    wanted = [np.unique(own[use & (mark & 2 == many)]) for many in (0, 2)]
    out = []
    for lo, _, part, part_at in tb.chunks(batch.column(1)):
        first, count, key = pieces(part, part_at)
        row = np.searchsorted(part_at, first, "right") - 1 + lo
        ask = row.astype(np.uint64) << np.uint64(32) | ((key & np.uint64(0xFFFFFFFF)) >> np.uint64(2))
        hot = _among(ask, wanted[1])
        take = _among(ask, wanted[0]) | hot
        row, first, count, key, hot = row[take], first[take], count[take], key[take], hot[take]
        if hot.any():  # a very common minimizer: its windows one by one
            n = np.where(hot, count, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, key, hot, first, count = (np.repeat(x, n) for x in (row, key, hot, first, count))
            first, count = first + nth, np.where(hot, 1, count)
            key = np.where(hot, tb.span_hash(tb.prefix_hash(part), first, first + count + LENGTH - 1), key)
        k1, k2 = keys(part, first, first + count + LENGTH - 1)
        out.append((row, first + at[lo], count, key, k1, k2))
    row, first, count, key, k1, k2 = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, first, count, key, k1.view(np.int64), k2.view(np.int64), data, at


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(x), bool)
    place = np.minimum(np.searchsorted(some, x), len(some) - 1)
    return some[place] == x


def _cut_out(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of each span as a binary value."""
    ends = np.cumsum(size)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    return packed(data[take], size)


def _distinct_pieces(parts: int):
    """Each piece of a batch once, with the least and greatest id that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row, first, count, key, k1, k2, data, _ = _found(batch, later=False)
            if not len(row):
                continue
            doc = ids[row]
            order = np.lexsort((doc, k2, k1))
            new = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
            start = np.flatnonzero(new)
            last = np.r_[start[1:], len(order)] - 1
            part = (key % np.uint64(parts)).astype(np.int32)
            for lo in range(0, len(start), 20_000):
                k, top = order[start[lo : lo + 20_000]], order[last[lo : lo + 20_000]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[k]), pa.array(doc[k]), pa.array(doc[top]), _cut_out(data, first[k], count[k] + LENGTH - 1)], names=["part", "low", "high", "piece"]
                )

    return run


def equal_windows(data: np.ndarray, start: np.ndarray, length: int, folder: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Order and classes of the windows of data that begin at start, by inserting one column a round.

    Returns the windows in suffix order, and for each place in that order the number of its
    class: places share a class if the common prefix with the place before is length.
    """
    m = len(start)
    columns = np.memmap(f"{folder}/columns", np.uint8, "w+", shape=(length, m))
    for j in range(length):
        columns[j] = data[start + j]
    # Order and prefixes of this round and of the next, which change places.
    (order, prefix), (next_order, next_prefix) = ([np.memmap(f"{folder}/{name}{i}", np.int32, "w+", shape=m) for name in ("order", "prefix")] for i in (0, 1))
    order[:], prefix[:] = np.arange(m), 0
    for j in range(length - 1, -1, -1):
        column, segment = np.array(columns[j]), columns[j]
        for lo in range(0, m, block):  # the column is read: this round's segment of the transform takes its place
            segment[lo : lo + block] = column[order[lo : lo + block]]
        count = np.bincount(column, minlength=256)
        filled = (np.cumsum(count) - count).astype(np.int32)  # where the next suffix with each first symbol goes
        classes, last = filled.copy(), np.full(256, -1, np.int32)
        for lo in range(0, m, block):
            symbol, before, those = (np.asarray(x[lo : lo + block]) for x in (segment, prefix, order))
            moved = np.argsort(symbol, kind="stable")
            symbol, before = symbol[moved], before[moved]
            first = np.r_[0, np.flatnonzero(symbol[1:] != symbol[:-1]) + 1].astype(np.int32)
            own, size = symbol[first], np.diff(np.r_[first, len(symbol)]).astype(np.int32)
            parted = np.ones(len(symbol), np.int32)
            parted[1:] = before[1:] != before[:-1]
            parted[first] = before[first] != last[own]
            run = np.cumsum(parted, dtype=np.int32)
            run += np.repeat(classes[own] - 1 - run[first] + parted[first], size)
            those, end = those[moved], first + size
            for to, a, b in zip(filled[own].tolist(), first.tolist(), end.tolist(), strict=True):
                next_order[to : to + b - a], next_prefix[to : to + b - a] = those[a:b], run[a:b]
            classes[own], last[own] = run[end - 1] + 1, before[end - 1]
            filled[own] += size
        order, prefix, next_order, next_prefix = next_order, next_prefix, order, prefix
    parted = np.zeros(m, np.int32)
    parted[1:] = prefix[1:] != prefix[:-1]
    return np.array(order), np.cumsum(parted, dtype=np.int32)


def _least_ids(table: pa.Table) -> pa.Table:
    """For each piece that shares a window: runs of windows with the least id that holds them."""
    low, high = table["low"].to_numpy(), table["high"].to_numpy()
    data, at = tb.utf8(table["piece"])
    k1, k2 = (k.view(np.int64) for k in keys(data, at[:-1], at[1:]))
    count = np.diff(at) - LENGTH + 1
    of = np.repeat(np.arange(len(k1)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    with tempfile.TemporaryDirectory() as folder:
        order, prefix = equal_windows(data, at[of] + nth, LENGTH, folder)
    start = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
    least, most = np.minimum.reduceat(low[of[order]], start), np.maximum.reduceat(high[of[order]], start)
    of_class = np.empty(len(of), np.int32)
    of_class[order] = prefix
    least, shared = least[of_class], (least < most)[of_class]
    first = np.r_[0, np.cumsum(count)[:-1]]
    use = np.maximum.reduceat(shared, first)
    one = np.zeros(len(k1), bool)  # a piece may have come from several tasks
    one[np.unique(np.stack([k1, k2]), axis=1, return_index=True)[1]] = True
    keep = np.repeat(use & one, count)
    of, least = of[keep], least[keep]
    new = np.r_[True, (of[1:] != of[:-1]) | (least[1:] != least[:-1])][: len(of)]
    begin = np.flatnonzero(new)
    runs = np.empty(len(begin), RUN)
    runs["n"], runs["doc"] = np.diff(np.r_[begin, len(of)]), least[begin]
    rows, size = np.unique(of[begin], return_counts=True)
    return pa.table({"k1": k1[rows], "k2": k2[rows], "runs": packed(runs, size)})


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, *code = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, *range(3, batch.num_columns)))
        row, first, _, _, k1, k2, _, at = _found(batch, later=True)
        for lo in range(0, len(row), 50_000):
            p = slice(lo, lo + 50_000)
            out = [k1[p], k2[p], ids[row[p]], first[p] - at[row[p]], *(c[row[p]] for c in code)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["k1", "k2", "id", "at", "text_hash"][: len(out)])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of bytes under windows that a smaller id holds."""
    for batch in batches:
        ids, at, *code = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, *range(3, batch.num_columns)))
        raw, ends = tb.utf8(batch.column(2))
        runs, count = np.frombuffer(raw.tobytes(), RUN), np.diff(ends) // RUN.itemsize
        row, n = np.repeat(np.arange(len(ids)), count), runs["n"].astype(np.int64)
        before = np.cumsum(n) - n
        before -= np.repeat(before[np.cumsum(count) - count] if len(before) else before, count) if len(before) else 0
        use = runs["doc"] < ids[row]
        begin = (at[row] + before)[use]
        out = [ids[row][use], *(c[row][use] for c in code), begin, begin + n[use] + LENGTH - 1]
        yield pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["id", *["text_hash"] * len(code), "lo", "hi"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            out: list[tuple] = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, end, gone, runs = [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    lo, hi = min(lo, len(raw)), min(hi, len(raw))
                    if lo > end or not runs and hi > lo:
                        kept.append(raw[end:lo])
                        runs += 1
                        gone, end = gone + hi - lo, hi
                    elif hi > end:
                        gone, end = gone + hi - end, hi
                kept.append(raw[end:])
                rest = b"".join(kept)
                out.append((len(raw), gone, runs, hashlib.sha256(rest).hexdigest(), rest))
            n, gone, runs, sha, rest = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def _ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.where("id is not null")


def _several(own: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The ids of (id, text) that have different texts, or None if there are none."""
    code = F.xxhash64("text")
    ids = own.groupBy("id").agg(F.min(code).alias("least"), F.max(code).alias("most")).where("least <> most").select("id")
    ids = scratch.written(ids, "several")
    return None if ids.isEmpty() else ids


def _hashed(rows: DataFrame, several: DataFrame | None, id_col: str, text_col: str, out: str) -> DataFrame:
    """rows as they are, or where ids have several texts with a column that tells them apart: their hash, or 0 for an id with one text."""
    if several is None:
        return rows
    spare = unused(rows, "cut_several")
    rows = rows.join(several.select(F.col("id").alias(spare)), rows[id_col].cast("long") == F.col(spare), "left")
    code = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return rows.withColumn(out, F.when(F.col(spare).isNotNull(), code).otherwise(0).cast("long")).drop(spare)


def _keys(own: DataFrame) -> list[str]:
    return [c for c in ("id", "text_hash") if c in own.columns]


def spans(own: DataFrame) -> DataFrame:
    """(id, lo, hi) from (id, text): spans of bytes that go, each of at least LENGTH bytes; they may overlap. With a column text_hash by (id, text_hash).

    Whole copies go at once, and the rest of the work sees one document of each text.
    """
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = _keys(own)
    more = by[1:]
    texts = own.select(*by, F.octet_length("text").cast("long").alias("hi"), F.sha2("text", 256).alias("sha"))
    firsts = texts.groupBy("sha").agg(F.min(F.struct(*by)).alias("first"))
    copies = texts.join(firsts, "sha").where((F.col("id") > F.col("first.id")) & (F.col("hi") >= LENGTH))
    copies = copies.select(*by, F.lit(0).cast("long").alias("lo"), "hi")
    once = own.join(firsts.select(*[f"first.{c}" for c in by]).distinct(), by)

    blocks = once.select("id", "text").mapInArrow(tb.released(_minimizers(max(4, parts // 3))), "bucket int, least long, value binary, doc binary")
    marks = blocks.groupBy("bucket").applyInArrow(_held_twice(COMMON), "id long, mark int").groupBy("id").agg(F.collect_list("mark").alias("marks"))
    marked = once.join(marks, "id").select("id", "text", "marks", *more)
    distinct = marked.mapInArrow(tb.released(_distinct_pieces(16 * parts)), "part int, low long, high long, piece binary")
    least = distinct.groupBy("part").applyInArrow(_least_ids, "k1 long, k2 long, runs binary")
    kind = "".join(f", {c} long" for c in more)
    where = marked.mapInArrow(tb.released(_occurrences), f"k1 long, k2 long, id long, at long{kind}")
    covered = where.join(least, ["k1", "k2"]).select("id", "at", "runs", *more).mapInArrow(tb.released(_covered), f"id long{kind}, lo long, hi long")
    return covered.union(copies)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for each row of docs."""
    own = _ids_and_texts(docs, id_col, text_col)
    own = _hashed(own, _several(own, Scratch(docs.sparkSession)), "id", "text", "text_hash")
    by = _keys(own)
    gone = spans(own).groupBy(*by).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = own.join(gone, by, "left").select("id", "text", "spans").union(nameless.withColumn("spans", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(tb.released(_without), schema).withColumnRenamed("id", id_col)


def _rest_of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *others, text, spans_ = batch.columns
        out = []
        for some in _without(iter([pa.RecordBatch.from_arrays([text, text, spans_], names=["id", "t", "s"])])):
            out += [x.decode("utf-8", "ignore") for x in some.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays([*others, pa.array(out, pa.string())], names=[*batch.schema.names[:-2], batch.schema.names[-2]])


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that is left, all other columns as they are.

    A character that loses some of its bytes goes whole; a null text becomes empty.
    """
    key, spans_col, code, own_code = (unused(docs, f"cut_{c}") for c in ("id", "spans", "code", "own_code"))
    own = _ids_and_texts(docs, id_col, text_col)
    several = _several(own, Scratch(docs.sparkSession))
    own = _hashed(own, several, "id", "text", "text_hash")
    by = _keys(own)
    gone = spans(own).groupBy(*by).agg(F.collect_list(F.struct("lo", "hi")).alias(spans_col)).withColumnsRenamed({"id": key, "text_hash": code})
    docs = _hashed(docs, several, id_col, text_col, own_code)
    same = docs[id_col].cast("long") == gone[key]
    joined = docs.join(gone, same & (docs[own_code] == gone[code]) if len(by) > 1 else same, "left")
    docs = docs.drop(own_code)
    others = [c for c in docs.columns if c != text_col]
    joined = joined.select(*[docs[c] for c in others], docs[text_col], spans_col)
    schema = docs.select(*others, text_col).schema
    return joined.mapInArrow(tb.released(_rest_of_text), schema).select(*docs.columns)
