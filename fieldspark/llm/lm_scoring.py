"""Scoring of documents by cross-entropy difference between two matched word models.

Method. A target model is counted from documents that are labelled good, a background model from all
documents. Both are bigram models of the same form over one vocabulary, which is every word of the
corpus, and both are counted on all tokens. Background counts are scaled to the size of the target, then
both are smoothed alike: a word's own frequency by ``BASE`` parts of its frequency in the corpus, a pair's by
``PRIOR`` tokens of the word's own frequency (what a context lacks to 1 is the end of the text).
Each token has a loss in bits under either; a document's score is the mean of the differences, target less
background: the lower, the more it is like the target. No document is scored by what it has itself
counted: its own counts are taken from both models first.

Scale. Texts are dealt into slices of about ``SLICE`` bytes. A slice sends each of its distinct words and pairs once,
with its counts, to blocks of the hash range, packed; a block adds up and answers each slice in the order it
asked; the slice, met again with its texts, scores them. What is gathered grows with the
corpus, as many blocks as slices, and nothing but a number of bytes reaches the driver. A very
frequent word or pair is one entry of each slice. Codes have ``SPARE`` bits more than the corpus' bytes can be
counted with (64 at most), so that at any size fewer than one in 2 ** ``SPARE`` meets another. Rows that repeat an id and text are spread by the partition they are
read in. The more slices, the smaller the cells they send; at worst a cell is one entry.

Edge cases. Words are runs of [^\\x20\\x09-\\x0D], with A-Z lowered. A null or empty text has 0 tokens
and null losses and score. Without any target token both models are the corpus' frequencies and
every score is 0. Labels that repeat an id count once; null ids and labels are no target. Repeated rows are counted and
scored each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textbytes as tb

PRIOR, BASE, SLICE = 100.0, 0.1, 8 << 20
CELLS, SPARE = 256, 17
BEGIN, TOTAL = np.uint64(1), np.uint64(2)
PAIR, SINGLE = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words before each text (and in all)."""
    data = tb.LOWER[data]
    begin, end, bounds = tb.words(data, at)
    return tb.span_hash(tb.prefix_hash(data), begin, end), bounds


def entries(word: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all pairs, then of all words, then of the beginnings of texts; and the first word of each text that has one."""
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[first] = BEGIN
    code = np.concatenate([before * PAIR + word, word ^ SINGLE, np.full(len(first), BEGIN ^ SINGLE)])
    return tb.mix(code) >> np.uint64(64 - bits), first


def added(code: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes in order, with each of the counts added up."""
    every, where = np.unique(code, return_inverse=True)
    return every, *(np.bincount(where, n, len(every)).astype(np.int64) for n in counts)


def slice_counts(text: pa.Array, target: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Distinct codes of some texts, how often they occur, and how often in texts of the target; TOTAL's are the tokens."""
    parts = [(np.array([TOTAL]), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    for lo, hi, data, at in tb.chunks(text):
        word, bounds = word_hashes(data, at)
        code, first = entries(word, bounds, bits)
        mark = np.repeat(target[lo:hi], np.diff(bounds)).astype(np.int64)
        parts.append((np.array([TOTAL]), np.array([len(word)]), np.array([mark.sum()])))
        parts.append(added(code, np.ones(len(code)), np.concatenate([mark, mark, mark[first]])))
    return added(*(np.concatenate(p) for p in zip(*parts, strict=True)))


def packed(*arrays: np.ndarray) -> bytes:
    """Their length, then of each array the first bytes of all values, then the second bytes and so on, compressed: most are 0 or 1."""
    planes = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in arrays)
    return len(arrays[0]).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: memoryview, *kinds: str) -> list[np.ndarray]:
    """The arrays of packed(), whose types are kinds."""
    m, wide = int.from_bytes(data[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.decompress(data[8:], m * sum(wide), codec="zstd"), np.uint8).reshape(-1, m)
    cut = np.cumsum([0, *wide])
    return [np.ascontiguousarray(planes[i:j].T).view(k).ravel() for i, j, k in zip(cut, cut[1:], kinds)]


def _cells(blocks: int, bits: int):
    """A slice's counts, a row for each block of the hash range: steps from code to code, counts, target counts."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [slice_counts(b.column("text"), np.asarray(b.column("target")), bits) for b in batches]
        every, n, t = added(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        block = ((every >> np.uint64(bits - 32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(block, prepend=-1, append=blocks))
        for some in range(0, len(cut) - 1, CELLS):
            spans = list(zip(cut[some : some + CELLS], cut[some + 1 : some + CELLS + 1]))
            cells = [packed(np.diff(every[i:j], prepend=np.uint64(0)), n[i:j].astype("<u4"), t[i:j].astype("<u4")) for i, j in spans]
            arrays = [pa.array([key[0].as_py()] * len(spans), pa.int32()), pa.array([block[i] for i, _ in spans], pa.int32()), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["slice", "block", "counts"])

    return run


def _totals(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers each cell of a block with the corpus' counts of its codes, in their order."""
    slices, codes, ns, ts = [], [], [], []
    for batch in batches:
        slices += batch.column("slice").to_pylist()
        for x in batch.column("counts"):
            step, own, marked = unpacked(memoryview(x.as_buffer()), "<u8", "<u4", "<u4")
            codes.append(np.cumsum(step, dtype=np.uint64))
            ns.append(own)
            ts.append(marked)
    cut = np.cumsum([0, *map(len, codes)])
    _, where = np.unique(np.concatenate(codes), return_inverse=True)
    n, t = (np.bincount(where, np.concatenate(x)).astype("<u8") for x in (ns, ts))
    for some in range(0, len(slices), CELLS):
        rows = range(some, min(some + CELLS, len(slices)))
        answers = [packed(n[where[cut[r] : cut[r + 1]]], t[where[cut[r] : cut[r + 1]]]) for r in rows]
        arrays = [pa.array([slices[r] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(answers, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["slice", "block", "totals"])


def losses(pair: np.ndarray, single: np.ndarray, context: np.ndarray, share: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of tokens under a model: counts of the pair, the word and the context, the word's share of the corpus, the model's tokens."""
    own = np.where(size > 0, (single + BASE * size * share) / np.maximum(size * (1 + BASE), 1e-300), share)
    return -np.log2((pair + PRIOR * own) / (context + PRIOR))


def token_losses(word: np.ndarray, bounds: np.ndarray, target: np.ndarray, bits: int, every: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses of each word of some texts under both models, less what its own text has counted."""
    code, first = entries(word, bounds, bits)
    length, k = np.diff(bounds), len(word)
    text = np.repeat(np.arange(len(length)), length)
    seen, where = np.unique(code, return_inverse=True)
    of = np.concatenate([text, text, text[first]])
    _, again, times = np.unique(of * len(seen) + where, return_inverse=True, return_counts=True)
    own = times[again]
    place = np.searchsorted(every, seen)[where]
    total = np.searchsorted(every, TOTAL)
    both, good = (n[place] - own).astype(np.float64), (t[place] - own * target[of]).astype(np.float64)
    # The context of a word is the word before it, or the beginning of the text.
    context = k + np.arange(k) - 1
    context[first] = 2 * k + np.arange(len(first))
    size = (t[total] - length * target)[text].astype(np.float64)
    scale = size / np.maximum((n[total] - length)[text], 1)
    share = n[place[k : 2 * k]] / n[total]
    return (
        losses(good[:k], good[k : 2 * k], good[context], share, size),
        losses(both[:k] * scale, both[k : 2 * k] * scale, both[context] * scale, share, size),
    )


def _scores(id_type: pa.DataType, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["id", "n_tokens", "target_loss", "background_loss", "score"]
    kinds = pa.schema(list(zip(names, [id_type, pa.int64(), *[pa.float64()] * 3])))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return kinds.empty_table()
        target = np.asarray(texts.column("target").combine_chunks()).astype(np.int64)
        every = slice_counts(texts.column("text"), target, bits)[0]
        n, t = [], []
        for x in answers.sort_by("block").column("totals"):
            every_n, target_n = unpacked(memoryview(x.as_buffer()), "<i8", "<i8")
            n.append(every_n)
            t.append(target_n)
        n, t = np.concatenate(n), np.concatenate(t)
        columns = [[], [], []]
        for lo, hi, data, at in tb.chunks(texts.column("text")):
            word, bounds = word_hashes(data, at)
            length = np.diff(bounds)
            some = length > 0
            means = np.zeros((2, hi - lo))
            if some.any():
                for mean, loss in zip(means, token_losses(word, bounds, target[lo:hi], bits, every, n, t), strict=True):
                    mean[some] = np.add.reduceat(loss, bounds[:-1][some]) / length[some]
            columns[0].append(length)
            columns[1].append(means)
            columns[2].append(~some)
        length, none = np.concatenate(columns[0]), np.concatenate(columns[2])
        good, back = np.concatenate(columns[1], axis=1)
        values = [pa.array(length, pa.int64()), *(pa.array(x, pa.float64(), mask=none) for x in (good, back, good - back))]
        return pa.table([texts.column("id"), *values], names=names).cast(kinds)

    return run


def score(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) for each row of docs; good(id) are the target's ids."""
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64), F.lit(0))).first()[0]
    slices = int(-(-size // SLICE)) or 1
    bits = min(64, max(40, SPARE + int(size).bit_length()))
    ids = good.select(F.col("id").cast("long").alias("good_id")).where("good_id is not null").distinct().withColumn("mark", F.lit(True))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    # Dealt by id at every size: labels grow with the corpus, so a broadcast would only suit small ones.
    marked = own.join(ids.hint("merge"), F.col("id").cast("long") == F.col("good_id"), "left")
    slot = F.pmod(F.xxhash64("id", "text", "part"), F.lit(slices)).cast("int")
    dealt = marked.select("id", "text", F.coalesce("mark", F.lit(False)).alias("target"), slot.alias("slice"))
    cells = dealt.groupBy("slice").applyInArrow(_cells(slices, bits), "slice int, block int, counts binary")
    answers = cells.groupBy("block").applyInArrow(_totals, "slice int, block int, totals binary")
    field = docs.schema[id_col]
    scored = dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        _scores(to_arrow_type(field.dataType), bits), f"id {field.dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, score double"
    )
    return scored.withColumnRenamed("id", id_col)
