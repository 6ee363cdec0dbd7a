"""Quality of documents by nearest-neighbour voting among labelled latent-semantic vectors.

Method. A text is a bag of terms, hashed into ``DIMS`` places: its words, which have two thirds of the places and more
than half of a vector's squared length, all three-character strings of character classes (which show shouting,
tables and strewn symbols), and a few terms for how often words and lines repeat. Terms are weighted by
their document frequency over all documents, and a truncated singular value decomposition of a bounded sample of labelled
rows (``max_labelled``, the rows of least hash) gives the latent space. The labelled vectors of that sample
are broadcast (``max_labelled * RANK`` floats at most); every document takes exact cosine
products with all of them, block by block, and its score is the mean label of
the ``k`` nearest, weighted by similarity.

Labels are read only from rows with crc32(id as text) mod 5 <> 0. Ids, labels, languages and
sources are never inputs of a score.

Edge cases. A null or empty text has no terms and gets the share of label 1 in the
sample. Without any labelled row every score is 0.5. Labels that repeat an id count
with their mean; null labels do not count. Ties in similarity go by the row of the sample. Extra columns
are ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import unused

CLASS_DIMS, WORD_DIMS, STAT_DIMS, WORD_WEIGHT, ROWS = 1024, 2304, 128, 1.5, 512
DIMS, RANK, NEAREST, MAX_LABELLED, GOOD = CLASS_DIMS + WORD_DIMS + STAT_DIMS, 96, 25, 4000, 0.3

_CLASS = np.full(256, 1, np.uint64)  # letters beyond ASCII count as lower case
_CLASS[:128] = np.arange(128)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_UPPER, _LETTER, _SYMBOL = _CLASS == 2, (_CLASS == 1) | (_CLASS == 2), np.isin(np.arange(256), [*b"#*$%&|<>"])


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.r_[0, np.cumsum(x, dtype=np.int64)]
    return run[at[1:]] - run[at[:-1]]


def _repeats(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each row how many of its keys are equal to an earlier one of the row."""
    order = np.lexsort((key, row))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=n)


def term_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of terms, a row for each text."""
    n = len(at) - 1
    out = np.zeros(n * DIMS, np.float32)
    if not len(data):
        return out.reshape(n, DIMS)
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    if len(data) > 2:
        three = (kind[:-2] << np.uint64(14)) | (kind[1:-1] << np.uint64(7)) | kind[2:]
        place = (tb.mix(three) % np.uint64(CLASS_DIMS)).astype(np.int64)
        whole = row[2:] == row[:-2]
        out += np.bincount((row[2:] * DIMS + place)[whole], minlength=n * DIMS)
    begin, end, bounds = tb.words(data, at)
    count = np.diff(bounds)
    word_row = np.repeat(np.arange(n), count)
    word = tb.span_hash(tb.prefix_hash(data), begin, end)
    place = CLASS_DIMS + (word % np.uint64(WORD_DIMS)).astype(np.int64)
    out += np.bincount(word_row * DIMS + place, minlength=n * DIMS)
    out = out.reshape(n, DIMS)

    # Stated shares, each one term out of a scale of eleven.
    together = (word[1:] == word[:-1]) & (word_row[1:] == word_row[:-1])
    line = np.flatnonzero((data == 10) | np.r_[False, row[1:] != row[:-1]])
    line_from = np.unique(np.r_[at[:-1][size > 0], line + (data[line] == 10)])
    line_from = line_from[line_from < len(data)]
    line_key = tb.span_hash(tb.prefix_hash(data), line_from, np.r_[line_from[1:], len(data)])
    letters = _sums(_LETTER[data], at)
    shares = [
        np.bincount(word_row[1:][together], minlength=n) / np.maximum(count, 1),
        _sums(_SYMBOL[data], at) / np.maximum(size, 1) * 5,
        _sums(_UPPER[data], at) / np.maximum(letters, 1),
        _repeats(line_key, row[line_from], n) / np.maximum(np.bincount(row[line_from], minlength=n), 1),
        _repeats(word, word_row, n) / np.maximum(count, 1),
        _sums(data == ord("|"), at) / np.maximum(count, 1) * 2,
        _sums(data == ord("!"), at) / np.maximum(count, 1),
    ]
    base = CLASS_DIMS + WORD_DIMS
    some = np.flatnonzero(count)
    for k, share in enumerate(shares):
        out[some, base + 12 * k + np.ceil(np.minimum(share[some], 1) * 10).astype(np.int64)] = 1
    out[some, base + 12 * len(shares) + np.minimum(np.log2(count[some]).astype(np.int64), 15)] = 1
    return out


def counted(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, counts) for runs of texts, bounded in bytes and in rows, as counts are dense."""
    for first in range(0, len(texts), ROWS):
        for lo, hi, data, at in tb.chunks(texts.slice(first, ROWS)):
            yield first + lo, first + hi, term_counts(data, at)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit blocks of words and of character classes, and the shares beside them."""
    x = np.log1p(counts) * idf
    for lo, hi, weight in ((0, CLASS_DIMS, 1.0), (CLASS_DIMS, CLASS_DIMS + WORD_DIMS, WORD_WEIGHT)):
        norm = np.sqrt((x[:, lo:hi] ** 2).sum(1, keepdims=True))
        x[:, lo:hi] *= weight / np.maximum(norm, 1e-9)
    x[:, CLASS_DIMS + WORD_DIMS :] = (counts[:, CLASS_DIMS + WORD_DIMS :] > 0) * np.float32(0.35)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for lo, hi, counts in counted(batch.column(0)):
            seen += (counts > 0).sum(0)
            n += hi - lo
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.r_[seen, n])], names=["dim", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some = [(np.flatnonzero(r), r[r > 0]) for _, _, counts in counted(batch.column(1)) for r in counts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([d.astype("<u2").tobytes() for d, _ in some], pa.binary()),
                pa.array([n.astype("<f4").tobytes() for _, n in some], pa.binary()),
            ],
            names=["label", "dims", "counts"],
        )


class Model:
    """Weights, latent space, labelled vectors and their labels; all of bounded size."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int):
        self.idf, self.basis, self.vectors, self.labels, self.k = idf, basis, vectors, labels, k

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = _unit(_weighted(counts, self.idf) @ self.basis) @ self.vectors.T
        k = min(self.k, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** 8 + 1e-12
        score = (weight * self.labels[best]).sum(1) / weight.sum(1)
        return np.where(counts.any(1), score, self.labels.mean())


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int, k: int) -> Model:
    """Document frequencies over all docs; latent space and labelled vectors from the bounded sample."""
    df = dict(docs.select(F.col(text_col).alias("text")).mapInArrow(tb.released(_frequencies), "dim int, n long").groupBy("dim").agg(F.sum("n")).collect())
    seen = np.array([df.get(i, 0) for i in range(DIMS)], float)
    idf = np.log((1 + df.get(DIMS, 0)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    known = known.where("id is not null and label is not null").where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    known = known.groupBy("id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))  # an id counts once, with its greatest text
    found = rows.orderBy("id").select("label", "text").mapInArrow(tb.released(_sparse), "label double, dims binary, counts binary").collect()
    y = np.array([r["label"] for r in found])

    def blocks() -> Iterator[np.ndarray]:
        for lo in range(0, len(found), 256):
            counts = np.zeros((len(found[lo : lo + 256]), DIMS), np.float32)
            for i, r in enumerate(found[lo : lo + 256]):
                counts[i, np.frombuffer(r["dims"], "<u2")] = np.frombuffer(r["counts"], "<f4")
            yield _weighted(counts, idf)

    gram = np.zeros((DIMS, DIMS), np.float32)
    for x in blocks():
        gram += x.T @ x
    # Leading eigenvectors of the terms' products by subspace iteration from a fixed start: the truncated decomposition.
    basis = np.random.default_rng(0).normal(size=(DIMS, 2 * RANK)).astype(np.float32)
    for _ in range(12):
        basis, _ = np.linalg.qr(gram @ basis)
    turn = np.linalg.eigh(basis.T @ gram @ basis)[1][:, ::-1][:, :RANK]
    basis = np.ascontiguousarray(basis @ turn).astype(np.float32)
    vectors = [_unit(x @ basis) for x in blocks()]
    return Model(idf, basis, np.concatenate(vectors) if vectors else np.zeros((0, RANK), np.float32), y, k)


def scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    k: int = NEAREST,
) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, max_labelled, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, counts in counted(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.value.score(counts))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tb.released(run), f"id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose text is predicted 0; all columns as they are, rows with null ids too.

    The score stands beside the row while it is taken, so no join is needed.
    """
    how = {"label_col": "quality", "max_labelled": MAX_LABELLED, "k": NEAREST} | how
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **how))
    last = unused(docs, "text_to_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            good = [model.value.score(counts) >= GOOD for _, _, counts in counted(text)]
            mask = pa.array(np.concatenate(good) if good else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    return docs.withColumn(last, F.col(text_col)).mapInArrow(tb.released(run), docs.schema)
