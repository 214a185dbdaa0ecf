"""Vectorised text kernels for Arrow batches: byte buffers, words, rolling and shingle hashes.

All functions work on one *block*: the concatenated UTF-8 bytes of some rows plus row offsets.
Blocks are cut by bytes (`blocks`), so memory does not depend on rows per Arrow batch; a row larger
than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 19
_U = np.uint64


def is_member(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes that end a word: blank and \t to \r; for word characters of the benchmark: all of ASCII but letters and digits.
BLANKS = is_member([(0x20, 0x20), (0x09, 0x0D)])


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for consecutive rows of a string column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, ...]:
    """(starts, ends, row of each word); words never cross rows."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: a permutation of the values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), seed + 1)


def _base(seed: int) -> int:
    return int(mix(np.array([seed], dtype=np.uint64), 77)[0]) | 1


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64 for an odd b (or its inverse)."""
    known = _powers.get((seed, inverse))
    if known is None or len(known) < n:
        base = _base(seed)
        base = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 8 * BLOCK_BYTES:  # those of a rare huge row are not kept
            _powers[seed, inverse] = known
    return known[:n]


class Rolling:
    """Hash of any slice of a block in O(1): polynomial over randomised byte values modulo 2^64."""

    def __init__(self, data: np.ndarray, seed: int = 0) -> None:
        self.inverse = powers(seed, len(data) + 1, inverse=True)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte_values(seed)[data] * powers(seed, len(data)), out=self.prefix[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


LONG_SLICE = 256
#: Masks of the first n bytes of a little-endian lane.
_LANES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice by a chain of mixing rounds over its 8-byte lanes, long ones by XXH3.

    Unlike `Rolling` it is no polynomial, so no family of texts collides by its algebra; where equal
    hashes stand for equal texts, these are the ones to use.
    """
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64), 41)
    active = np.flatnonzero((size > 0) & (size <= LONG_SLICE))
    for at in range(0, LONG_SLICE, 8):
        if not len(active):
            break
        lane = lanes[starts[active] + at] & _LANES[np.minimum(size[active] - at, 8)]
        out[active] = mix(out[active] ^ lane, 42)
        active = active[size[active] > at + 8]
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG_SLICE).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
    return out


def shingle_hashes(word_hash: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each window of n words; rows with fewer words give one window of all of them."""
    if len(word_hash) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    multipliers = mix(np.arange(1, n + 1, dtype=np.uint64), 5) | _U(1)
    full = np.zeros(0, np.uint64)
    full_rows = np.zeros(0, np.int64)
    count = len(word_hash) - n + 1
    if count > 0:
        valid = np.flatnonzero(rows[:count] == rows[n - 1 :])
        full = np.full(len(valid), n, dtype=np.uint64)
        for k in range(n):
            full += word_hash[valid + k] * multipliers[k]
        full, full_rows = mix(full), rows[valid]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    length = np.diff(np.r_[first, len(rows)])
    short = length < n
    if not short.any():
        return full, full_rows
    extra = length[short].astype(np.uint64)
    for k in range(n - 1):
        has = length[short] > k
        extra[has] += word_hash[first[short][has] + k] * multipliers[k]
    order = np.argsort(np.r_[full_rows, rows[first[short]]], kind="stable")
    return np.r_[full, mix(extra)][order], np.r_[full_rows, rows[first[short]]][order]


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Start of each row's entries in sorted `rows`, with an end marker."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def distinct_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of every row, in row order (A-Z lower-cased)."""
    for _, data, offsets in blocks(column):
        data = lower_ascii(data)
        starts, ends, rows = words(data, offsets)
        hashes, of = shingle_hashes(slice_hashes(data, starts, ends), rows, n)
        bounds = row_bounds(of, len(offsets) - 1)
        for i in range(len(offsets) - 1):
            part = np.sort(hashes[bounds[i] : bounds[i + 1]])
            yield part[np.r_[True, part[1:] != part[:-1]]] if len(part) else part
