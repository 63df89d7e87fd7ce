"""Vectorised word and shingle hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20240501)
#: One random odd 64-bit factor for each byte; white space counts as zero.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_PLACE = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A letter's place in its word counts by this factor before the two are mixed.
_AT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words with good avalanche (the splitmix64 finaliser)."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text each (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size, dtype=np.int64), 0
    while start < len(size):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased) and the n + 1 offsets of the rows among the words.

    Each letter is mixed with its place, and the results are added up: unlike a polynomial, such a sum has no words
    that collide by their build.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = _SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = space[:-1]
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    place = np.arange(starts[0], len(data), dtype=np.uint64)
    place -= np.repeat(starts, np.diff(starts, append=len(data))).astype(np.uint64)
    value = mix64(_BYTE[data[starts[0] :]] + place * _AT)
    value[space[starts[0] :]] = 0
    hashes = mix64(np.add.reduceat(value, starts - starts[0]))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one after the other, and n + 1 offsets.

    A row with fewer than five words has its whole sequence as one shingle; none without words.
    """
    hashes, at = word_hashes(*text_bytes(column))
    n = len(at) - 1
    count = np.diff(at)
    total = max(0, len(hashes) - SHINGLE + 1)
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(SHINGLE):
        rolled[:total] += hashes[k : k + total] * _PLACE[k]
    rolled = mix64(rolled)
    parts, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        m = count[i]
        if m >= SHINGLE:
            own = np.sort(rolled[at[i] : at[i + 1] - SHINGLE + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif m:
            own = mix64((hashes[at[i] : at[i + 1]] * _PLACE[:m]).sum(dtype=np.uint64, keepdims=True) + _PLACE[SHINGLE:] * np.uint64(m))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))
