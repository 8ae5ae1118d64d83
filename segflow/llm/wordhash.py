"""Vectorised hashes of words and word n-grams over Arrow batches of texts.

A word is a run of bytes other than U+0020 and U+0009-U+000D. Hashes are polynomial
(Rabin-Karp) modulo 2**64 with an odd base, so that windows of any length come from
prefix sums; word hashes are mixed first, and serve as coefficients of window hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE_BYTE, BASE_WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes hashed at once; it bounds the memory of a task, not what is hashed.
SEGMENT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Rows that a task turns over at once; it bounds memory, not what is done.
ROWS = 2048

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: idle workers keep theirs beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a function for mapInArrow, on batches of ROWS rows, with memory released in between."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(part for batch in batches for part in (batch.slice(i, ROWS) for i in range(0, len(batch), ROWS))):
            yield out
            del out
            release()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 4 * SEGMENT:
            _powers[base] = have
    return have


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):  # pieces of about SEGMENT bytes, cut between words
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(BASE_BYTE, hi - lo)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum((buf[lo:hi].astype(U) + U(1)) * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s])
        i = j
    return out


def text_batches(column: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) of runs of rows of about ``limit`` bytes; a null is empty."""
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(buf: np.ndarray, rows: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each row the place of its first word (and the end)."""
    if lower:
        buf = _LOWER[buf]
    if not len(buf):
        return np.zeros(0, U), np.zeros(len(rows), np.int64)
    space = _SPACE[buf]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = rows[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return _hash_words(buf, starts, ends), np.searchsorted(starts, rows)


def windows_of(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of each run of n words, whatever rows they belong to; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, U)
    up, down = powers(BASE_WORD, len(words))
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column whose item k holds the bytes of values[cuts[k]:cuts[k + 1]]."""
    width = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((np.asarray(cuts, np.int64) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    ).cast(pa.binary())
