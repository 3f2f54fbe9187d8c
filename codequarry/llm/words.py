"""Words of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A batch is looked at as one run of UTF-8 bytes.  Separators are single bytes,
so word borders are array comparisons, and the hash of every word is a
difference of one running sum (a polynomial hash over random byte values,
modulo 2**64, mixed at the end).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
# Texts are hashed so many bytes at a time, which bounds what a worker holds for any length of text.
HASH_BYTES = 1 << 17

_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true within the ranges (both ends included)."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


WHITE_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALPHANUMERIC = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    steps = np.full(HASH_BYTES, base & _MASK, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of every word ``data[start:end]``; the words are in order."""
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        begin = int(start[first])
        last = int(np.searchsorted(end, begin + HASH_BYTES, "right"))
        if last > first:
            at, to = start[first:last] - begin, end[first:last] - begin
            size = int(to[-1])
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTES[data[begin:begin + size]] * _UP[:size], out=sums[1:])
            out[first:last] = (sums[to] - sums[at]) * _DOWN[at]
            first = last
        else:  # one word longer than a block
            total, factor = 0, 1
            for at in range(begin, int(end[first]), HASH_BYTES):
                piece = data[at:min(at + HASH_BYTES, int(end[first]))]
                total += int((_BYTES[piece] * _UP[:len(piece)]).sum()) * factor
                factor = factor * pow(_BASE, HASH_BYTES, 1 << 64) & _MASK
            out[first] = total & _MASK
            first += 1
    return mix(out)


@dataclass
class Words:
    """Word hashes of several texts; text ``d`` owns ``hashes[first[d]:first[d + 1]]``."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def parts(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts add up to ``max_bytes``, or to one whole text that is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def tokenize(texts: pa.Array, separators: np.ndarray) -> Words:
    """Words of each text after lower-casing A-Z; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return Words(np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    data = _LOWER[np.frombuffer(data_buffer, np.uint8)[offsets[0]:offsets[-1]]]
    borders = offsets - offsets[0]
    n = len(data)
    apart = separators[data]
    inner = borders[(borders > 0) & (borders < n)]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, apart[:-1]
    after[-1], after[:-1] = True, apart[1:]
    before[inner], after[inner - 1] = True, True
    start = np.flatnonzero(~apart & before)
    end = np.flatnonzero(~apart & after) + 1
    return Words(_hashes(data, start, end), np.searchsorted(start, borders))


_TURNS = np.random.default_rng(613).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` consecutive words."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    last = len(hashes) - size + 1
    total = np.full(last, size, np.uint64)
    for j in range(size):
        total += hashes[j:j + last] * _TURNS[j % 64] if j < 64 else mix(hashes[j:j + last] + np.uint64(j))
    return mix(total)


def shingle_sets(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct ``size``-word shingles; a shorter text is one shingle."""
    every = windows(words.hashes, size)
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if end - begin >= size:
            yield np.unique(every[begin:end - size + 1])
        else:
            yield windows(words.hashes[begin:end], end - begin) if end > begin else np.empty(0, np.uint64)
