"""Words of whole texts and their 64-bit hashes, computed a batch at a time in numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. These bytes never
occur inside a UTF-8 sequence, so texts are worked on as bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
# An odd base and its inverse modulo 2^64: prefix sums of base powers give any run's hash.
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


class Words(NamedTuple):
    """Words of several texts: text i has words bounds[i] to bounds[i + 1]."""

    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base; those that a piece needs are kept."""
    if len(_powers[base]) < n:
        grown = np.full(max(n, PIECE_BYTES + 64), base, np.uint64)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        if n > 4 * PIECE_BYTES:
            return grown
        _powers[base] = grown
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal runs wherever they lie."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many at once that their texts stay below PIECE_BYTES."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of bytes, about PIECE_BYTES of them at a time."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + PIECE_BYTES, "right")))
        values = data[low : ends[last - 1]].astype(np.uint64)
        values += np.uint64(1)
        out[first:last] = run_hashes(values, starts[first:last] - low, ends[first:last] - low)
        first = last
    return out


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on after it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(texts: pa.Array, fold: bool = False, gaps: np.ndarray = SPACE) -> Words:
    """All words of the texts; `fold` lower-cases A-Z first, `gaps` marks the bytes between words."""
    data, limits = text_bytes(texts)
    if fold:
        data = FOLD[data]
    inside = ~gaps[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[limits[:-1][limits[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[limits[1:][limits[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = word_hashes(data, starts, ends)
    return Words(np.searchsorted(starts, limits), hashes, starts, ends, data)


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` consecutive words of one text, and their bounds per text.

    Window j of text i begins at the text's word j.
    """
    counts = np.maximum(np.diff(found.bounds) - size + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(found.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    return run_hashes(found.hashes, first, first + size), bounds
