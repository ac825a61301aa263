"""Vectorised scanning of UTF-8 text held in Arrow string arrays.

All functions work on one bounded slice of a batch: ``data`` are the bytes of
some consecutive texts and ``offsets`` says where each of them begins (one more
entry than texts).  A single text is never cut.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of the words ``[^\x20\x09-\x0D]+``.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[0x20] = VISIBLE[0x09:0x0E] = False
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
#: Bytes of text for which the powers stay in memory; workers are used again, so those of longer slices go.
KEPT = 1 << 19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(column: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (index of the first text, data, offsets) with about ``max_bytes`` of text each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one entry more)."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[offsets < n]] = False
    after[:-1] = inside[1:]
    after[offsets[offsets > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power_table(base: int, size: int) -> np.ndarray:
    step = np.full(size, base, np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of ``data``, by one prefix sum."""
    n = len(data)
    powers = _powers
    if len(powers[0]) <= n:
        powers = [_power_table(base, max(n + 1, KEPT)) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
        if n < KEPT:
            _powers[:] = powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers[1][starts])


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries (also across texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + hashes[k : k + n]
    return mix(out)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """For windows of ``size`` words at every position: does it lie in one text?"""
    total = int(first[-1])
    n = max(total - size + 1, 0)
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + size <= last
