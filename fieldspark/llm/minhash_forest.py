"""Near-duplicate documents by an LSH forest of MinHash signatures.

Method. Every distinct shingle set gets one signature of ``trees * depth`` minima.
Each tree sorts all signatures by its own ``depth`` minima. The depth adapts to the
region: a set's depth in a tree is the longest prefix that a run of more than ``REACH + 1``
sorted neighbours shares with it. Sets in sparse regions meet their sorted neighbours, which
are all sets of the region; sets in dense regions meet the set beside them and the region's most
central set, whose minima are the commonest over all trees. So a hub with thousands of
copies around it is found without listing pairs of a region. Candidates that pass a bound
on set sizes and a cut on 128 bits of their minima, which travel with the sorted
rows, are confirmed on the full shingle sets of the texts.

What the forest does not bring together (or where its sorted rows are parted) follows exactly, for all sets that share two minima of a tree with another
(a linked pair does in some tree but for (1 - J^2)^trees: 1e-9 at J = 0.85, 8e-8 at 0.8; with too few trees for that, for
all sets). The space of shingle hashes is
parted in ``k = 2 * (h + 1)`` ranges, where two sets over the threshold differ in at most ``h``
shingles (given their sizes). What a set has in a range is one key, so two such sets share at least
``k - h`` of their ``k`` keys, and among the ``h + 1`` rarest keys of each, in any order of all keys, one
is common. Keys hold some three shingles each, so sets that merely share usual
shingles or a template do not meet. The order is by how often a key is in a sample, then by
hash; the sample only orders, any order finds all pairs. Keys that one component alone
has are dropped before anything is compared, so a large group of near copies costs nothing; sets under
a key first meet its most central set, and only keys that still join different components make pairs. A pair is
made under the first key that its sets share and, but for keys that stand far apart, under no other.

Two cuts spare the full comparison. The lowest bits of 128 minima may differ by a tail of 1e-9 (if minima were
independent). The parities of the shingles in 512 ranges differ in no more places than the sets differ in
shingles, which is a bound without a tail.

Edge cases. A null or empty text, or one without words, has an empty set and is
linked with nothing. A text with fewer words than a shingle is one shingle. Equal
sets (copies, repeated rows) are one class, so copies are never expanded into pairs.
A null id is returned with a null component and kept = false. Rows that repeat an id are one document; if
their texts differ, it has the links of all of them. Extra columns of any
name are ignored by ``components`` and returned as they are by ``keep_one``. The call runs Spark jobs: its
intermediate tables are written to the shared folder and deleted before it returns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..numbering import row_numbers
from . import textbytes as tb
from .shared import Scratch, connected_components, small_batches, unused, written

TREES, DEPTH, SHORTEST, REACH = 16, 8, 2, 3
#: Ranges whose parities bound how much two sets differ; a power of two.
PARITIES = 512
#: Ids that are broadcast at most; beyond, tables are joined by an exchange.
FEW = 1 << 20
#: Rows of the forest that a partition holds at least, if there are so many.
ROWS = 1 << 13
#: One document in SAMPLE, and at most USUAL keys of those, only say in which order keys are taken.
SAMPLE, USUAL = 8, 1 << 19
#: Keys of a set before one it shares that tell whether a pair has met before.
EARLIER = 4
#: Bytes of texts that a worker turns into arrays at once.
AT_ONCE = 1 << 18
_PLACES = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    data = tb.LOWER[data]
    begin, end, bounds = tb.words(data, at)
    word = tb.span_hash(tb.prefix_hash(data), begin, end)
    if not len(word):
        return [word] * (len(at) - 1)
    place = np.resize(_PLACES, size)
    rows = np.zeros(len(word), np.uint64)
    if len(word) >= size:
        n = len(word) - size + 1
        for j in range(size):
            rows[:n] += word[j : j + n] * place[j]
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(tb.mix(rows[lo : hi - size + 1])))
        elif hi > lo:
            out.append(tb.mix((word[lo:hi] * place[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(word[:0])
    return out


def bounds_of_sizes(num: int, den: int, top: int) -> np.ndarray:
    """Greatest sizes of the size classes up to top; sets over the threshold are in one class or in two that follow each other."""
    found = [1]
    while found[-1] < top:
        found.append(max(found[-1] + 1, -(-found[-1] * den // num)))
    return np.array(found, np.int64)


def _ranges(sets: list[np.ndarray], num: int, den: int):
    """Keys of the ranges of each set, for its own size class and the next: (row, class, key, keys that must be taken)."""
    n = np.array([len(s) for s in sets], np.int64)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = np.flatnonzero(n)
    every, row = np.concatenate(sets), np.repeat(np.arange(len(full)), n[full])
    top = bounds_of_sizes(num, den, int(n.max()) + 1)
    own = np.searchsorted(top, n[full])
    top = np.r_[top, max(top[-1] + 1, -(-top[-1] * den // num))]
    out = []
    for more in (0, 1):
        size_class = own + more
        differ = (den - num) * 2 * top[size_class] // (den + num)
        k = 2 * (differ + 1)
        before = np.r_[0, np.cumsum(k)]
        place = before[row] + ((every >> np.uint64(32)) * k[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        total = np.zeros(before[-1], np.uint64)
        total[place[start]] = np.add.reduceat(tb.mix(every ^ np.uint64(0x5DEECE66D)), start)
        of = np.repeat(np.arange(len(full)), k)
        nth = np.arange(len(of)) - before[of]
        salt = tb.mix((size_class[of] * 1_000_003 + nth).astype(np.uint64))
        out.append((full[of], size_class[of], tb.mix(total ^ salt), np.where(differ > 0, differ + 1, 0)[of]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rarest(sets: list[np.ndarray], num: int, den: int, usual: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """For each set the keys that one of its partners must share, as an array<long>."""
    row, size_class, key, take = _ranges(sets, num, den)
    known, often = usual
    count = np.zeros(len(key), np.int64)
    if len(known) and len(key):
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        count = np.where(known[place] == key, often[place], 0)
    order = np.lexsort((key, count, size_class, row))
    row, size_class, key, take = row[order], size_class[order], key[order], take[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (size_class[1:] != size_class[:-1])][: len(row)]
    first = np.flatnonzero(new)
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    use = nth < take
    ends = np.r_[0, np.cumsum(np.bincount(row[use], minlength=len(sets)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(key[use].view(np.int64)))


def _signed(size: int, trees: int, depth: int):
    """Of each text: size of its set, class of equal sets, the low 16 bits of its minima, one bit of 128 of them, and parities of 512 ranges."""
    rng = np.random.default_rng(5)
    times = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(1), AT_ONCE):
                sets = shingle_hashes(data, at, size)
                count = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(count)
                every = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
                start = np.r_[0, np.cumsum(count[full])[:-1]].astype(np.int64)
                minima = np.zeros((len(sets), trees * depth), np.uint16)
                key = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    short = (every >> np.uint64(32)).astype(np.uint32)
                    for p in range(trees * depth):
                        least = np.minimum.reduceat((short ^ plus[p]) * times[p], start)
                        minima[full, p] = (least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)
                    key[full, 0] = np.add.reduceat(tb.mix(every ^ np.uint64(0x1234567)), start)
                    key[full, 1] = np.bitwise_xor.reduceat(tb.mix(every + np.uint64(0x7654321)), start) + count[full].astype(np.uint64)
                odd = np.zeros((len(sets), PARITIES), np.uint8)
                if len(full):
                    place = np.repeat(full, count[full]) * PARITIES + (every & np.uint64(PARITIES - 1)).astype(np.int64)
                    odd = (np.bincount(place, minlength=odd.size) & 1).astype(np.uint8).reshape(odd.shape)
                odd = np.packbits(odd, axis=1)
                bits = np.zeros((len(sets), 16), np.uint8)
                packed = np.packbits((minima[:, :128] & 1).astype(np.uint8), axis=1)
                bits[:, : packed.shape[1]] = packed
                two = bits.view(np.int64)
                big = minima.astype(">u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                        pa.array(count),
                        pa.array([k.tobytes() for k in key], pa.binary()),
                        pa.array([r.tobytes() for r in big], pa.binary()),
                        pa.array(two[:, 0].copy()),
                        pa.array(two[:, 1].copy()),
                        pa.array([r.tobytes() for r in odd], pa.binary()),
                    ],
                    names=["id", "n", "class", "signature", "u", "v", "odd"],
                )

    return run


def _neighbours(reach: int, shortest: int, depth: int, num: int, den: int, unequal: int):
    """Rows (tree, key, id, n, u, v), sorted by tree and key: candidate pairs, and the region of each set that has a dense one.

    A pair is (a, b) with region null, the larger id first; a set of a dense region is (id, null, region, n, u, v). Only rows of one
    partition that stand near each other are compared; where a partition ends a region may look sparser than it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = reach + 1
        bits = lambda z: np.bitwise_count(z.view(np.uint64)).astype(np.int64)
        held: tuple | None = None
        context = 0

        def look(rows: tuple, begin: int, end: int) -> pa.RecordBatch:
            """What rows[begin:end] give, with all that stands around them."""
            tree, key, ids, n, u, v = rows
            m = len(ids)
            same = np.zeros(m, np.int64)  # common prefix with the row before
            if m > 1:
                alike = np.logical_and.accumulate(key[1:] == key[:-1], axis=1).sum(1)
                same[1:] = np.where(tree[1:] == tree[:-1], alike, 0)
            deep = np.zeros(m, np.int64)
            span = np.lib.stride_tricks.sliding_window_view(same[1:], edge).min(1) if m > edge else np.zeros(0, np.int64)
            for j in range(edge + 1):  # the run of edge + 1 rows that begins j rows before
                deep[j : j + len(span)] = np.maximum(deep[j : j + len(span)], span)
            dense = deep >= shortest
            a, b = [], []
            for step in range(1, reach + 1):
                if m <= step:
                    break
                prefix = np.lib.stride_tricks.sliding_window_view(same[1:], step).min(1)
                x, y = np.arange(step, m), np.arange(m - step)
                near = (prefix >= shortest) & (x >= begin) & (x < end)
                near &= (step == 1) | ~(dense[x] & dense[y])
                x, y = x[near], y[near]
                near = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
                near &= bits(u[x] ^ u[y]) + bits(v[x] ^ v[y]) <= unequal
                a.append(ids[x[near]])
                b.append(ids[y[near]])
            p, q = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
            own = np.flatnonzero(dense[begin:end]) + begin
            level = deep[own]
            region = tree[own].astype(np.uint64) * np.uint64(64) + level.astype(np.uint64)
            for j in range(depth):
                region = np.where(j < level, tb.mix(region ^ (key[own, j].astype(np.uint64) << np.uint64(20)) ^ np.uint64(j + 1)), region)
            kind = np.repeat([0, 1], [len(p), len(own)])

            def column(values: list, has: np.ndarray) -> pa.Array:
                full = np.zeros(len(kind), np.int64)
                full[has] = np.concatenate(values)
                return pa.array(full, mask=~has)

            has = kind == 1
            return pa.RecordBatch.from_arrays(
                [
                    column([np.maximum(p, q), ids[own]], kind >= 0),
                    column([np.minimum(p, q)], kind == 0),
                    *(column([x], has) for x in (region.view(np.int64), n[own], u[own], v[own])),
                ],
                names=["a", "b", "region", "n", "u", "v"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, _ = tb.utf8(batch.column(1))
            key = raw.reshape(-1, depth, 2).view(np.uint16)[:, :, 0]
            rest = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
            rows = (tree, key, *rest)
            if held is not None:  # rows whose surroundings were not complete, and those before them
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            end = max(context, len(rows[0]) - edge)
            yield look(rows, context, end)
            keep = max(0, end - 2 * edge)
            held, context = tuple(x[keep:] for x in rows), end - keep
        if held is not None:
            yield look(held, context, len(held[0]))

    return run


def shingle_set(text: str | None, size: int) -> frozenset:
    """The set itself: words with A-Z lowered; fewer words than a shingle are one; none without words."""
    found = (text or "").encode().lower().split()
    if len(found) < size:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(zip(*(found[i:] for i in range(size)), strict=False))


def _confirmed(size: int, num: int, den: int):
    """Pairs whose full sets satisfy den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=64)(lambda text: shingle_set(text, size))
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = known(x.as_py()), known(y.as_py())
                both = len(s & t)
                good.append(bool(both) and den * both >= num * (len(s) + len(t) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _keys(size: int, num: int, den: int, usual):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(1), AT_ONCE):
                keys = _rarest(shingle_hashes(data, at, size), num, den, usual.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), keys], names=["id", "keys"])

    return run


def _near_enough(num: int, den: int):
    """Candidates (a, b, n_a, n_b, x, y) whose parities differ in no more places than sets over the threshold can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
            x, y = (tb.utf8(batch.column(i))[0].reshape(batch.num_rows, -1) for i in (4, 5))
            good = pa.array((num + den) * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (den - num) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return run


def _usual_keys(own: DataFrame, size: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of those that are most frequent in a sample; at most ``USUAL``, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in tb.chunks(batch.column(0), AT_ONCE):
                _, _, key, _ = _ranges(shingle_hashes(data, at, size), num, den)
                every, count = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "c"])

    some = own.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(tb.released(run), "key long, c long")
    often = some.groupBy("key").agg(F.sum("c").alias("c")).where("c > 1").orderBy(F.desc("c"), "key").limit(USUAL).toArrow()
    key = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], often.column("c").to_numpy()[order]


def _most_unequal(places: int, num: int, den: int) -> int:
    """How many lowest bits of ``places`` minima differ at the threshold but for a tail of 1e-9."""
    p = (1 - num / den) / 2
    tail, k = 1.0, -1
    while tail > 1e-9 and k < places:
        k += 1
        tail -= comb(places, k) * p**k * (1 - p) ** (places - k)
    return k


def _likely(num: int, den: int, places: int, n: str = "n", m: str = "m"):
    """Whether sizes and 128 bits of minima of (n, u, v) and (m, x, y) allow a pair over the threshold."""
    unequal = F.bit_count(F.col("u").bitwiseXOR(F.col("x"))) + F.bit_count(F.col("v").bitwiseXOR(F.col("y")))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (unequal <= _most_unequal(min(places, 128), num, den))


def _within(num: int, den: int, x: str = "odd", y: str = "odd_b", n: str = "n", m: str = "m"):
    """The bound of _near_enough() on parities as longs in arrays."""
    unequal = sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(PARITIES // 64))
    return (num + den) * unequal <= (den - num) * (F.col(n) + F.col(m))


def _with_earlier(held: DataFrame) -> DataFrame:
    """Distinct rows (id, key, ..) with the number of keys of the id, and the last ``EARLIER`` that it has before each key, in ascending order."""
    own = W.partitionBy("id")
    return held.withColumn("earlier", F.collect_list("key").over(own.orderBy("key").rowsBetween(-EARLIER, -1))).withColumn("pop", F.count("*").over(own))


def _meeting(held: DataFrame, other: DataFrame, could: Column) -> DataFrame:
    """Pairs (a, b) of held(id, key, earlier, ..) and other(id_b, key, earlier_b, ..), the same rows, that satisfy could, which must not depend on the key.

    Two sets that share one of their last keys too have met before. Under the first key that they share they have not, so
    no pair is lost, whatever ``EARLIER`` is; it may come more than once.
    """
    new = (F.col("id") > F.col("id_b")) & could & ~F.arrays_overlap("earlier", "earlier_b")
    return held.join(other, "key").where(new).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most ``FEW`` rows, so that texts are not exchanged for it."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _pair(x: str, y: str):
    return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")


def components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    num: int = 80,
    den: int = 100,
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked if den * |intersection| >= num * |union| of their sets of
    ``shingle``-word shingles; component_id is the smallest id that links reach.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        out = _grouped(own, shingle, num, den, trees, depth)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def _texts_apart(own: DataFrame, several: DataFrame, scratch: Scratch, how: tuple) -> DataFrame:
    """(id, n_shingles, component_id) where the ids in several have different texts: each text gets an id of its own, linked with the others of its id."""
    own = own.withColumn("hash", F.xxhash64("text"))
    texts = own.join(_small(several), "id", "left_semi").select("id", "hash").distinct()
    low, high = own.agg(F.min("id"), F.max("id")).first()
    n = several.count()
    first = high + 1 if high < 1 << 62 else low - (1 << 40)
    if n and not -(1 << 63) <= first < (1 << 63) - (1 << 40):
        raise ValueError("ids take the whole range of 64 bits, so texts that share one get none of their own")
    texts = scratch.written(row_numbers(texts, ["id", "hash"], "own_id", first=first, scratch=scratch), "texts-of-ids")
    few = F.broadcast(texts) if texts.count() <= FEW else texts
    # Rows of these ids meet their own number by id and hash; null texts hash alike.
    named = own.join(few, ["id", "hash"], "left").select(F.coalesce("own_id", "id").alias("id"), "text")
    least = texts.groupBy("id").agg(F.min("own_id").alias("b"))
    same = texts.join(least, "id").select(F.col("own_id").alias("a"), "b").where("a <> b")
    out = _grouped(named, *how, same=scratch.written(same, "same"))
    out = out.join(few.select(F.col("own_id").alias("id"), F.col("id").alias("was")), "id", "left")
    out = out.select(F.coalesce("was", "id").alias("id"), "n_shingles", "component_id")
    real = scratch.written(out.groupBy("component_id").agg(F.min("id").alias("real")), "real")
    return out.join(real, "component_id", "left").select("id", "n_shingles", F.col("real").alias("component_id"))


def _grouped(own: DataFrame, shingle: int, num: int, den: int, trees: int, depth: int, same: DataFrame | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of rows (id, text); same holds links (a, b) that are given."""
    spark = own.sparkSession
    scratch = Scratch(spark)
    places = trees * depth
    likely = _likely(num, den, places)
    schema = "id long, n long, class binary, signature binary, u long, v long, odd binary"
    signed = scratch.written(own.mapInArrow(tb.released(_signed(shingle, trees, depth)), schema), "signed")
    full = signed.where("n > 0 and id is not null")
    if same is None:
        several = signed.where("id is not null").groupBy("id").agg(F.min("class").alias("x"), F.max("class").alias("y"))
        several = scratch.written(several.where("x <> y").select("id"), "several")
        if not several.isEmpty():
            out = written(_texts_apart(own, several, scratch, (shingle, num, den, trees, depth)), "members")
            scratch.drop()
            return out
    classes = full.groupBy("class").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "u", "v", "signature", "odd")])
    classes = scratch.written(classes, "classes")

    # The forest: sorted orders, their neighbours and dense regions.
    wide = 2 * depth
    forest = classes.select("id", "n", "u", "v", F.posexplode(F.array(*[F.substring("signature", t * wide + 1, wide) for t in range(trees)])).alias("tree", "key"))
    runs = forest.select(F.xxhash64("tree", "key").alias("run"), "id")
    often = runs.groupBy("run").agg(F.count("*").alias("c")).where("c > 1")
    central = scratch.written(runs.join(often, "run").groupBy("id").agg(F.sum(F.log2("c")).cast("decimal(20,6)").alias("pop")), "central")
    # A partition's first rows have nothing before them, so small tables are few partitions; what is parted all the same is left to the exact way.
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), 1 + classes.count() * trees // ROWS)
    order = forest.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").select("tree", "key", "id", "n", "u", "v")
    walk = _neighbours(REACH, SHORTEST, depth, num, den, _most_unequal(min(places, 128), num, den))
    walked = scratch.written(order.mapInArrow(tb.released(walk), "a long, b long, region long, n long, u long, v long"), "walked")
    dense = walked.where("region is not null").select(F.col("a").alias("id"), "region", "n", "u", "v").join(central, "id", "left")
    dense = dense.withColumn("pop", F.coalesce("pop", F.lit(0)))
    top = F.max(F.struct("pop", (-F.col("id")).alias("minus"), "n", "u", "v")).alias("top")
    leaders = dense.groupBy("region").agg(top)
    leaders = leaders.select("region", (-F.col("top.minus")).alias("leader"), F.col("top.n").alias("m"), F.col("top.u").alias("x"), F.col("top.v").alias("y"))
    led = dense.join(leaders, "region").where((F.col("id") != F.col("leader")) & likely).select(*_pair("id", "leader"))
    pairs = walked.where("a <> b").select("a", "b").union(led).distinct()
    odd = classes.select("id", "n", "odd")
    pairs = pairs.join(odd.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("x")), "a")
    pairs = pairs.join(odd.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("y")), "b")
    pairs = scratch.written(pairs.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(tb.released(_near_enough(num, den)), "a long, b long"), "pairs")

    def texts_of(some: DataFrame) -> DataFrame:
        ends = _small(scratch.written(some.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends"))
        return scratch.written(own.join(ends, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")), "texts")

    def confirm(some: DataFrame, text: DataFrame, name: str) -> DataFrame:
        with_a = some.select("a", "b").join(text.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        both = with_a.join(text.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return scratch.written(both.select("a", "b", "text_a", "text_b").mapInArrow(tb.released(_confirmed(shingle, num, den)), "a long, b long"), name)

    def joined(links: DataFrame) -> DataFrame:
        return scratch.written(connected_components(links, scratch=scratch), "part")

    def across(some: DataFrame, part: DataFrame) -> DataFrame:
        """Of the pairs those of different components."""
        some = some.join(part.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
        some = some.join(part.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        return some.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    # First each set with the most central of its candidates, then what still joins different components.
    text = texts_of(pairs)
    either = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = either.groupBy("a").agg(F.count("*").alias("c"))
    ranked = degree.select(F.col("a").alias("b"), F.struct(F.col("c"), (-F.col("a")).alias("minus")).alias("rank"))
    first = either.join(ranked, "b").groupBy("a").agg(F.max("rank").alias("rank")).select("a", (-F.col("rank.minus")).alias("b"))
    first = scratch.written(first.select(*_pair("a", "b")).distinct(), "first")
    links = confirm(first, text, "sure")
    if same is not None:
        # The class of a text is known by its least id.
        ids = full.select("class", "id").join(classes.select("class", F.col("id").alias("first_id")), "class").select("id", "first_id").distinct()
        given = same.join(ids.withColumnRenamed("id", "a").withColumnRenamed("first_id", "x"), "a").join(ids.withColumnRenamed("id", "b").withColumnRenamed("first_id", "y"), "b")
        links = links.union(scratch.written(given.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b"), "given"))
    part = joined(links)
    rest = scratch.written(across(pairs.join(first, ["a", "b"], "left_anti"), part), "rest")
    links = links.union(confirm(rest, text, "more"))
    part = joined(links)

    # The exact way: keys that sets of different components have.
    starts = forest.select(F.xxhash64("tree", F.substring("key", 1, 2 * SHORTEST)).alias("run"), "id")
    met = starts.groupBy("run").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("run")
    active = starts.join(met, "run", "left_semi").select("id").distinct()
    if (1 - (num / den) ** SHORTEST) ** trees > 1e-7:
        active = classes.select("id").distinct()
    active = scratch.written(active, "active")
    these = own.join(_small(active), "id", "left_semi")
    usual = spark.sparkContext.broadcast(_usual_keys(these, shingle, num, den))
    keys = scratch.written(these.mapInArrow(tb.released(_keys(shingle, num, den, usual)), "id long, keys array<long>"), "keys")
    keyed = keys.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key")
    few = keyed.join(scratch.written(shared, "shared"), "key", "left_semi").distinct()
    held = scratch.written(few.join(part, "id", "left").withColumn("component", F.coalesce("component", "id")), "held")
    apart = held.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    words = F.array(*[F.conv(F.hex(F.substring("odd", 8 * i + 1, 8)), 16, -10).cast("long") for i in range(PARITIES // 64)])
    held = held.join(apart, "key", "left_semi").join(classes.select("id", "n", "u", "v", words.alias("odd")), "id")
    held = scratch.written(_with_earlier(held), "apart")
    if not held.isEmpty():
        # Under each key first its most central set: the one with most keys that others have too.
        theirs = ("component", "n", "u", "v", "odd")
        leaders = held.groupBy("key").agg(F.max(F.struct("pop", (-F.col("id")).alias("minus"), *theirs)).alias("top"))
        named = [F.col(f"top.{c}").alias(d) for c, d in zip(theirs, ("other", "m", "x", "y", "odd_b"), strict=True)]
        leaders = leaders.select("key", (-F.col("top.minus")).alias("id_b"), *named)
        could = (F.col("component") != F.col("other")) & likely & _within(num, den)
        led = held.drop("earlier", "pop").join(leaders, "key").where(could).select(*_pair("id", "id_b")).distinct()
        led = scratch.written(led.join(pairs, ["a", "b"], "left_anti"), "led")
        late = confirm(led, texts_of(led), "late")
        if not late.isEmpty():
            links = links.union(late)
            part = joined(links)
            held = held.drop("component").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
        named = zip((*theirs, "earlier"), ("other", "m", "x", "y", "odd_b", "earlier_b"), strict=True)
        other = held.select("key", F.col("id").alias("id_b"), *[F.col(c).alias(d) for c, d in named])
        last = scratch.written(_meeting(held, other, could).distinct().join(pairs, ["a", "b"], "left_anti").join(led, ["a", "b"], "left_anti"), "last")
        latest = confirm(last, texts_of(last), "latest")
        if not latest.isEmpty():
            part = joined(links.union(latest))

    ids = classes.select("class", F.col("id").alias("first_id")).join(part.withColumnRenamed("id", "first_id"), "first_id", "left")
    ids = ids.select("class", F.coalesce("component", "first_id").alias("component"))
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(ids, "class", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    out = written(out, "members")
    scratch.drop()
    usual.unpersist()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id stays, with all its columns.

    Rows with a null id stay. Of rows that repeat one id, all stay or none.
    """
    spare = unused(docs, "near_id")
    gone = components(docs, id_col, text_col, **how).where(F.col(id_col).isNotNull() & ~F.col("kept"))
    gone = _small(written(gone.select(F.col(id_col).alias(spare)).distinct(), "gone"))
    return docs.join(gone, docs[id_col] == gone[spare], "left_anti")
