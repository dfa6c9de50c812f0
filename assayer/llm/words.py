"""Words of Arrow text columns as arrays: where each starts and ends, and a 64-bit hash of it.

The texts of a batch lie one after another in one UTF-8 buffer. All separators used here are ASCII bytes, so words can be
cut on bytes. A word's hash is the sum of one pseudo-random number for each of its bytes and their places in the word, taken
from one running sum over the buffer. Unlike a polynomial modulo 2**64, it has no words that are known to collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
LETTERED = np.zeros(256, dtype=bool)
LETTERED[0x30:0x3A] = LETTERED[0x61:0x7B] = LETTERED[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES * 2), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(steps)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair; equal runs have equal hashes wherever they lie."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power(_P, n), out=sums[1:])
    return mixed((sums[end] - sums[start]) * _power(_P_INV, n + 1)[start] + (end - start).astype(np.uint64))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    begin = np.zeros(len(data), dtype=np.int64)
    begin[start] = start
    place = np.arange(len(data)) - np.maximum.accumulate(begin) if len(data) else begin
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mixed(_BYTE[data] + place.astype(np.uint64) * _P), out=sums[1:])
    return mixed(sums[end] - sums[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of text d; ``start`` and ``end`` are bytes of ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, null as empty, and the offset of each text in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    original, offsets = buffer(column)
    data = _LOWER[original] if lower else original
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = kind[data]
    here = inside[1:-1]
    before, after = inside[:-2].copy(), inside[2:].copy()
    starts, ends = offsets[:-1], offsets[1:] - 1
    before[starts[starts < n]] = False
    after[ends[ends >= 0]] = False
    start = np.flatnonzero(here & ~before)
    end = np.flatnonzero(here & ~after) + 1
    return Words(data, offsets, start, end, _word_hashes(data, start, end), np.searchsorted(start, offsets))


def word_counts(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> np.ndarray:
    """How many words each text has."""
    data, offsets = buffer(column)
    inside = (kind[_LOWER] if lower else kind)[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    start[at] = inside[at]
    return np.diff(np.concatenate([[0], np.cumsum(start)])[offsets])


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of k words of one text: index of its first word, its hash, and where each text's windows begin."""
    count = np.maximum(np.diff(w.first) - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], count)
    return at, run_hashes(mixed(w.hash), at, at + k), first


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text, each of one row at least."""
    column = batch.column(text)
    _, offsets = buffer(column)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
