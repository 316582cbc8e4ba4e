"""Words and hashes of many texts at once, over Arrow's UTF-8 buffers and without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text handled at once; a longer text is handled alone. Temporary arrays take about 60 times as much.
SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def spread(text: str, most: int, parts: int = 10) -> Column:
    """A text column, where it has over `most` characters as `parts` stretches of most / parts characters, evenly spread from beginning to end; for samples to learn from."""
    size, piece = F.length(text), most // parts
    cut = (F.substr(text, (F.floor((size - piece) * F.lit(k) / (parts - 1)) + 1).cast("int"), F.lit(piece)) for k in range(parts))
    return F.when(size > most, F.concat_ws("\n", *cut)).otherwise(F.col(text))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes; a null text is an empty one."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes other than ASCII white space, within one text), and for each text the number of words before it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    inner = offsets[offsets < n]
    before[inner] = True
    starts = np.flatnonzero(before & ~space)
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` hashes in a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= np.uint64(_BASE)
        total += hashes[k : k + n]
    return mix(total)


def representatives(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row for each distinct hash, for each row the place in that list). Linear: rows claim slots of a table, again and again until each has met its like."""
    n = len(hashes)
    owner = np.full(n, -1, np.int64)
    left = np.arange(n)
    bits = max(8, int(n).bit_length())
    turn = 0
    while len(left):
        salted = hashes[left] * np.uint64(_BASE + 2 * turn) if turn else hashes[left]
        slot = (salted >> np.uint64(64 - bits)).astype(np.int64)
        table = np.full(1 << bits, -1, np.int64)
        table[slot[::-1]] = left[::-1]
        held = table[slot]
        same = hashes[held] == hashes[left]
        owner[left[same]] = held[same]
        left = left[~same]
        bits = max(8, int(len(left)).bit_length() + 1)
        turn += 1
    first = np.flatnonzero(owner == np.arange(n))
    place = np.empty(n, np.int64)
    place[first] = np.arange(len(first))
    return first, place[owner]
