"""Texts of an Arrow batch as one byte array, and hashes of their words and shingles.

A batch's texts lie back to back in one buffer, so words, lines and shingles
of all of them are found by a few numpy passes and no Python loop over
characters. Hashes have 64 bits: a polynomial over the bytes taken modulo
2**64 whose result is mixed; the chance that two of N different words or
shingles meet is about N**2 / 2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 18
#: Words of a shingle.
SHINGLE_WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@contextmanager
def task_memory(*caches: dict) -> Iterator[None]:
    """Gives back at a task's end what a worker would go on to hold: the entries of ``caches``, and unused memory of Arrow and of the C library."""
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)


def text_slices(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column: first row, end row, bytes, offsets of the texts in them.

    Null texts are empty. A slice has ``limit`` (``SLICE_BYTES``) bytes at most, or one text.
    """
    limit = limit or SLICE_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators, and the number before each text."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[edges] = inside[1:-1][edges]
    ends[edges[1:] - 1] = inside[1:-1][edges[1:] - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans; A-Z count as a-z if ``lower``."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _PLACE[7])


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of texts whose words begin at ``firsts``, and where each text's begin.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    counts = np.diff(firsts)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(firsts), np.int64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    sums = padded[:n] * _PLACE[0]
    for i in range(1, k):
        sums += padded[i : i + n] * _PLACE[i]
    keep = np.ones(n, bool)
    for i in range(1, k):  # the last k - 1 words of a text begin no shingle
        at = firsts[1:] - i
        keep[at[(at > firsts[:-1]) | ((at == firsts[:-1]) & (i >= k))]] = False
    short = np.flatnonzero((counts > 0) & (counts < k))
    for c in range(1, k):
        at = firsts[short[counts[short] == c]]
        total = np.full(len(at), np.uint64(c), np.uint64) * _PLACE[6]
        for i in range(c):
            total += words[at + i] * _PLACE[i]
        sums[at] = total
    return mixed(sums[keep]), np.concatenate([[0], np.cumsum(keep)])[firsts]


def texts_shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts of a slice, with repeats, in order, and where each text's begin."""
    starts, ends, firsts = word_spans(data, offsets)
    return shingle_hashes(span_hashes(data, starts, ends), firsts, k)


def distinct_shingles(column: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    for row, end, data, offsets in text_slices(column):
        hashes, firsts = texts_shingles(data, offsets, k)
        for i in range(end - row):
            own = np.sort(hashes[firsts[i] : firsts[i + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
