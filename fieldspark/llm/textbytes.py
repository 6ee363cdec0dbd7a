"""Arrays over whole batches of texts: byte buffers, word spans and 64-bit hashes.

Every helper works on the UTF-8 bytes of many texts at once, so that the Python
part of an operator costs a few nanoseconds a byte and never a loop over
characters. Texts are handled in chunks of about a megabyte, which bounds memory
whatever the batch holds; a text longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

# The separators of words, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 2)
        pair = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            pair.append(np.multiply.accumulate(row))
        _powers = tuple(pair)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins and the last ends. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    got = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return got[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole texts of about limit bytes."""
    data, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def released(run: Callable) -> Callable:
    """run over the batches of a task, after which the worker gives free memory back: it waits for other stages' tasks with it else."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            pa.system_memory_pool().release_unused()

    return whole


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins, where it ends, and the number of words before each text (and in all)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    first = at[:-1][at[:-1] < at[1:]]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[first] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[first[1:] - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(begin, at)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; span_hash() takes the hash of any span from two of them."""
    power, _ = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=run[1:])
    return run


def span_hash(run: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One mixed 64-bit hash for each span; equal bytes have equal hashes wherever they stand."""
    _, inverse = powers(len(run))
    return mix((run[end] - run[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def window_hash(run: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k bytes that follow each other."""
    n = len(run) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, inverse = powers(len(run))
    return mix((run[k:] - run[:n]) * inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values that follow each other."""
    if len(x) < w:
        return x[:0]
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == w else np.minimum(x[: len(x) - (w - have)], x[w - have :])
