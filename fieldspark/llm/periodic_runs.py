"""Runs of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least
twice as long as q and of ``minimum`` words, that no neighbouring word extends.

Method: block convolution. At the scale of blocks of B = 1, 2, 4, .. words, periods from 2 B - 1 to 4 B - 2 are sought. A run of such a
period holds a whole aligned block whose copy, a period later, lies in it too. So for each block the squared
differences to all stretches of the following window are summed, ``sum x^2 + sum y^2 - 2 sum x y``, the last by a
number-theoretic transform modulo a prime, on integers: each zero is an occurrence without a mismatch, and its distance a
seed. Seeds of neighbouring blocks are chained and extended word by word in both directions, which also
refutes sums that are only a multiple of the prime.

Blocks without a chance are not transformed: the rarest word of a block must come again within the distances; and a block
whose window lies in a run of period B or less meets itself at multiples of that period only, which are no smallest periods.

Scale. Texts are taken in chunks of about a megabyte, which share the transforms of a scale; a word that occurs nowhere else stands between
two texts. A longer text is a chunk of its own. There is no shuffle; a text's work is about n log^2 n.

Edge cases. A null or empty text has no words and no runs, and collapses to an empty text. Texts
of any length are taken whole. Words are compared as bytes. Ids, ties and repeated rows have no influence; extra columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text of a chunk, about; values that one call of the transform holds.
CHUNK, HELD = 1 << 20, 1 << 20
#: A prime of the form k 2^30 + 1 below 2^32, so products fit 64 bits, and a generator of its units.
PRIME, GENERATOR = np.uint64(3 * 2**30 + 1), 5
WORD = r"[^\x20\x09-\x0D]+"
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first size powers of a root of unity of order 2 * size, or of its inverse."""
    key = size, inverse
    if key not in _roots:
        p = int(PRIME)
        root = pow(GENERATOR, (p - 1) // (2 * size), p)
        row = np.ones(1, np.uint64)
        step = pow(root, -1, p) if inverse else root
        while len(row) < size:
            row = np.concatenate([row, row * np.uint64(pow(step, len(row), p)) % PRIME])
        _roots[key] = row
    return _roots[key]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two long), or its inverse."""
    m, n = rows.shape
    a, size = rows.reshape(m, n, 1), 1
    # Halves of the index move from the front to the back, so no order of reversed bits is needed.
    while size < n:
        half = a.shape[1] // 2
        even, odd = a[:, :half], a[:, half:] * _powers(size, inverse) % PRIME
        a = np.concatenate([(even + odd) % PRIME, (even + (PRIME - odd)) % PRIME], axis=2)
        size *= 2
    a = a.reshape(m, n)
    return a * np.uint64(pow(n, -1, int(PRIME))) % PRIME if inverse else a


def occurrences(x: np.ndarray, squares: np.ndarray, at: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the zero sums of squared differences of the blocks that begin at ``at``, for distances from 2 block - 1 to 4 block - 2.

    squares holds the running sums of squares of x; x goes on for 5 * block words that occur nowhere else.
    """
    size, found = 4 * block, []
    near = 2 * block - 1
    for lo in range(0, len(at), max(1, HELD // size)):
        s = at[lo : lo + max(1, HELD // size)]
        left, right = np.zeros((len(s), size), np.uint64), np.zeros((len(s), size), np.uint64)
        left[:, :block] = x[s[:, None] + np.arange(block - 1, -1, -1)]
        right[:, : 3 * block - 1] = x[s[:, None] + near + np.arange(3 * block - 1)]
        cross = transform(transform(left) * transform(right) % PRIME, inverse=True)[:, block - 1 : 3 * block - 1]
        t = s[:, None] + near + np.arange(2 * block)
        both = (squares[s + block] - squares[s])[:, None] + squares[t + block] - squares[t]
        row, shift = np.nonzero(both % PRIME == (cross + cross) % PRIME)
        found.append((s[row], near + shift))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _extend(x: np.ndarray, at: np.ndarray, d: np.ndarray, n: int, step: int) -> np.ndarray:
    """How far x[i] == x[i + d] holds from each at on (step 1: at itself and beyond; -1: below at), as the first place where it doesn't.

    x goes on beyond n with words that occur nowhere else, so no stretch leaves the n words.
    """
    at = at.copy()
    alive = np.arange(len(at))
    for _ in range(32):
        i = at[alive] if step > 0 else at[alive] - 1
        alive = alive[(i >= 0) & (i < n)]
        i = at[alive] if step > 0 else at[alive] - 1
        alive = alive[x[i] == x[np.minimum(i + d[alive], len(x) - 1)]]
        if not len(alive):
            return at
        at[alive] += step
    for k in alive.tolist():
        width, i, dist = 64, int(at[k]), int(d[k])
        while True:
            w = min(width, n - i if step > 0 else i, len(x) - i - dist)
            if w <= 0:
                break
            lo = i if step > 0 else i - w
            differ = np.flatnonzero(x[lo : lo + w] != x[lo + dist : lo + w + dist])
            if len(differ):
                i = lo + int(differ[0]) if step > 0 else lo + int(differ[-1]) + 1
                break
            i, width = i + step * w, 2 * width
        at[k] = i
    return at


def runs_of(words: np.ndarray, minimum: int = 12, longest: int | None = None) -> np.ndarray:
    """(start, length, period) of every run among integers from 0 on, by start and period; no text has more than longest of them."""
    n = len(words)
    longest = n if longest is None else longest
    if n < minimum:
        return np.zeros((0, 3), np.int64)
    count = np.bincount(words)
    top = 1
    while 4 * top - 1 <= longest // 2:
        top *= 2
    # One more word after the end stands for all that occur nowhere else: blocks never hold it, only windows do.
    x = np.concatenate([words, np.full(5 * top + 1, len(count))]).astype(np.uint64)
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * x % PRIME)])
    key = np.sort(words.astype(np.int64) * (n + 1) + np.arange(n))
    rare = count[words]
    covered, period = np.zeros(n + 1, np.int64), np.ones(n + 1, np.int64)  # of each word, a run of small period that goes far: its end and period
    found, fresh = [np.zeros((0, 3), np.int64)], []
    block = 1
    while 2 * block - 1 <= longest // 2:
        for start, length, q in [r for rows in fresh for r in rows.tolist()]:
            if q <= block and length >= 3 * block:  # others hold no block and its copy at this scale or a later one
                here = start + np.flatnonzero(covered[start : start + length] < start + length)
                covered[here], period[here] = start + length, q
        fresh = [r[r[:, 2] > block] for r in fresh]
        at = np.arange(0, n - block + 1, block)
        at = at[covered[at] < at + 5 * block - 2]
        if block > 1 and len(at):
            # The rarest word of each block.
            whole = rare[: len(rare) // block * block].reshape(-1, block)
            pick = at + np.argmin(whole[at // block], axis=1)
        else:
            pick = at
        if len(at):
            base = words[pick].astype(np.int64) * (n + 1) + pick
            k = np.searchsorted(key, base + 2 * block - 1)
            here = k < len(key)
            here[here] = key[k[here]] <= base[here] + 4 * block - 2
            # The next key may belong to a greater word: then it exceeds the last place of this one.
            here &= key[np.minimum(k, len(key) - 1)] // (n + 1) == words[pick]
            at = at[here]
        if len(at):
            s, d = occurrences(x, squares, at, block)
            new = (covered[s] < s + d + block) | (d % period[s] > 0)  # else a multiple of that run's period
            s, d = s[new], d[new]
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            first = np.ones(len(s), bool)
            first[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + block)
            last = np.roll(first, -1)
            if len(s):
                begin, end, dist = s[first], s[last], d[first]
                # A seed that the words refute has no extent: its block itself is compared again.
                low = _extend(x, begin + 0, dist, n, -1)
                high = _extend(x, begin + 0, dist, n, 1)
                real = high >= end + block
                rows = np.stack([low, high + dist - low, dist], axis=1)
                mixed = np.flatnonzero(~real)
                if len(mixed):  # a chain with a refuted seed: each of its blocks stands alone
                    chain = np.cumsum(first) - 1
                    lone = np.isin(chain, mixed)
                    a, dd = s[lone], d[lone]
                    lo, hi = _extend(x, a, dd, n, -1), _extend(x, a, dd, n, 1)
                    rows = np.concatenate([rows[real], np.stack([lo, hi + dd - lo, dd], axis=1)[hi >= a + block]])
                rows = rows[(rows[:, 1] >= minimum) & (rows[:, 1] >= 2 * rows[:, 2])]
                if len(rows):
                    found.append(rows)
                    fresh.append(rows)
        block *= 2
    rows = np.concatenate(found)
    # One stretch has one smallest period; any other that fits twice is a multiple of it.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    rows = rows[~same]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_runs(docs: DataFrame, minimum: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) for each row.

    runs: array of (start, length, period) in words, by start and period. collapsed: the text's words, joined by one space, without those that a run
    holds after its first period.
    """

    def chunk(texts: list[bytes]) -> tuple[list[int], list[int], np.ndarray, list[bytes]]:
        split = [t.split() for t in texts]
        sizes = np.array([len(w) for w in split])
        flat = [w for words in split for w in words]
        if not flat:
            return [0] * len(texts), [0] * (len(texts) + 1), np.zeros((0, 3), np.int64), [b""] * len(texts)
        codes = pa.array(flat, pa.large_binary()).dictionary_encode()
        codes = codes.indices.to_numpy()
        begin = np.cumsum(sizes) - sizes
        # Between two texts stands a word of its own.
        words = np.full(len(flat) + len(texts), -1, np.int64)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)
        words[place] = codes
        gaps = np.flatnonzero(words < 0)
        words[gaps] = int(codes.max()) + 1 + np.arange(len(gaps))
        rows = runs_of(words, minimum, int(sizes.max()))
        text = np.searchsorted(begin + np.arange(len(texts)), rows[:, 0], "right") - 1
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, rows[:, 0] + rows[:, 2], 1)
        np.add.at(drop, rows[:, 0] + rows[:, 1], -1)
        keep = (np.cumsum(drop)[:-1] == 0)[place]
        out = []
        for w, lo, n in zip(split, begin.tolist(), sizes.tolist(), strict=True):
            mine = keep[lo : lo + n]
            out.append(b" ".join(w if mine.all() else compress(w, mine.tolist())))
        rows[:, 0] -= (begin + np.arange(len(texts)))[text]
        return sizes.tolist(), np.searchsorted(text, np.arange(len(texts) + 1)).tolist(), rows, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
                part = batch.slice(lo, hi - lo)
                n, ends, rows, kept = chunk([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                runs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), runs, text], names=["id", "n_words", "runs", "collapsed"])
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by a hash of its id repeats a stretch of its words from some place to its end; the rest are as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    g = F.floor(F.col("h") / 10).cast("long")
    rows = rows.withColumn("g", g).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    one = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(one, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The rows of the query: counts, the longest run and digests, from those of periodic_runs()."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("best", best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
