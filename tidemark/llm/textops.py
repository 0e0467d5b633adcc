"""Vectorised text primitives over Arrow string columns: words, shingles, hashes.

All functions work on UTF-8 bytes with numpy, whole texts, any length. A column
is processed in runs of rows holding about CHUNK bytes so that memory follows
the chunk (or the single longest text), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives freed memory back to the machine after each of them, as idle Python workers would hold on to it."""

    def trimmed(batches):
        try:
            for out in run(batches):
                yield out
                del out
                release()
        finally:
            release()

    return trimmed


def release() -> None:
    """Gives memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over every output bit."""
    x = np.array(x, dtype=np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _P), np.full(n, _P_INV)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def chunks(column: pa.Array, size: int = CHUNK, most: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds from 0) for runs of at most `most` rows of about `size` bytes."""
    if not len(column):
        return
    data, bounds = buffers(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        stop = min(row + most, max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1))
        yield row, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each maximal run of `inside` bytes that stays in one row."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    first, last = bounds[:-1], bounds[1:] - 1
    before[first[first < n]] = False
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(bounds, starts, "right") - 1, starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _K)


def space_words(data: np.ndarray, bounds: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased if `fold`."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    rows, starts, ends = spans(~gap, bounds)
    return rows, span_hashes(lower_ascii(data) if fold else data, starts, ends)


def letter_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    low = lower_ascii(data)
    rows, starts, ends = spans(((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128), bounds)
    return rows, span_hashes(low, starts, ends)


def letter_parts(data: np.ndarray, bounds: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word of letter_words(), and of every beginning of the given numbers of bytes of longer ones."""
    low = lower_ascii(data)
    rows, starts, ends = spans(((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128), bounds)
    row_parts, hash_parts = [rows], [span_hashes(low, starts, ends)]
    for size in prefixes:
        longer = np.flatnonzero(ends - starts > size)
        row_parts.append(rows[longer])
        hash_parts.append(mix(span_hashes(low, starts[longer], starts[longer] + size) + np.uint64(size)))
    return np.concatenate(row_parts), np.concatenate(hash_parts)


def grams(rows: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and first word's index of each run of n words of one row."""
    if len(words) < n:
        return rows[:0], words[:0], np.zeros(0, np.int64)
    last = len(words) - n + 1
    total = np.zeros(last, np.uint64)
    for j in range(n):
        total = total * _K + words[j : j + last]
    at = np.flatnonzero(rows[:last] == rows[n - 1 :])
    return rows[at], mix(total[at] + np.uint64(n)), at


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of the column.

    Shingles are runs of n words; a row with 1 to n-1 words has its whole word
    sequence as one shingle, a row without words an empty set.
    """
    for first, data, bounds in chunks(column):
        rows, words = space_words(data, bounds)
        counts = np.bincount(rows, minlength=len(bounds) - 1)
        at_word = np.concatenate(([0], np.cumsum(counts)))
        of_gram, hashes, _ = grams(rows, words, n)
        at_gram = np.searchsorted(of_gram, np.arange(len(counts) + 1))
        for row, count in enumerate(counts.tolist()):
            if count >= n:
                yield first + row, np.unique(hashes[at_gram[row] : at_gram[row + 1]])
            elif count:
                total = np.zeros(1, np.uint64)
                for word in words[at_word[row] : at_word[row + 1]]:
                    total = total * _K + word
                yield first + row, mix(total + np.uint64(count))
            else:
                yield first + row, hashes[:0]


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of hashes."""
    total = mix(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
