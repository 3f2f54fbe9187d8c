"""Elias-Fano lists and the n-gram trie levels built from them, as flat buffers.

A level is one buffer that is read in place: arrays are views of it, so it can
be mapped from a file or a received message without being decoded.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

_PIECE = 1 << 18


class Monotone:
    """A non-decreasing list of integers: low bits packed, high bits in unary, with a count of zeros per word."""

    def __init__(self, buffer: bytes | mmap.mmap | memoryview, at: int = 0) -> None:
        self.n, self.low_bits, low_bytes, words = struct.unpack_from("<QQQQ", buffer, at)
        at += 32
        self.low = np.ndarray((low_bytes - 7,), "<u8", buffer, at, (1,))
        at += low_bytes
        self.high = np.frombuffer(buffer, np.uint8, 8 * words, at).reshape(-1, 8)
        at += 8 * words
        self.zeros = np.frombuffer(buffer, "<u8", words + 1, at)
        self.end = at + 8 * (words + 1)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        """The list as bytes; ``values`` are non-negative and below 2**62."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        mask = np.uint64((1 << bits) - 1)
        low = np.unpackbits((values & mask).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
        packed = np.packbits(low.ravel(), bitorder="little").tobytes()
        packed += bytes(8 + (-(len(packed) + 8)) % 8)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = (int(high[-1]) if n else 0) + 2
        words = -(-length // 64)
        unary = np.zeros(64 * words, np.uint8)
        unary[high] = 1
        ones = unary.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        zeros = np.concatenate(([0], np.cumsum(64 - ones))).astype("<u8")
        return struct.pack("<QQQQ", n, bits, len(packed), words) + packed + np.packbits(unary, bitorder="little").tobytes() + zeros.tobytes()

    def _lows(self, index: np.ndarray) -> np.ndarray:
        bit = index * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """How many members have high bits below ``bucket``."""
        out = np.zeros(len(bucket), np.int64)
        total = int(self.zeros[-1])
        ask = np.flatnonzero(bucket > 0)
        for begin in range(0, len(ask), _PIECE):
            part = ask[begin:begin + _PIECE]
            nth = bucket[part] - 1  # the zero that ends the bucket before
            beyond = nth >= total
            nth = np.minimum(nth, total - 1)
            word = np.searchsorted(self.zeros, nth.astype(np.uint64), "right") - 1
            inside = nth - self.zeros[word].astype(np.int64)
            inside = inside.astype(np.uint8)
            sums = np.cumsum(8 - np.bitwise_count(self.high[word]), axis=1, dtype=np.uint8)
            byte = (sums <= inside[:, None]).sum(axis=1)
            rest = inside - np.where(byte > 0, np.take_along_axis(sums, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
            bits = 1 - np.unpackbits(self.high[word, byte][:, None], axis=1, bitorder="little")
            bit = (np.cumsum(bits, axis=1, dtype=np.uint8) <= rest[:, None]).sum(axis=1)
            out[part] = np.where(beyond, self.n, word * 64 + byte * 8 + bit - nth)
        return out

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first member that is at least the value, for each value, and whether it equals it."""
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        at, end = self._before(high), self._before(high + 1)
        same = np.zeros(len(at), bool)
        live = np.flatnonzero(at < end)
        while len(live):
            own = self._lows(at[live])
            same[live[own == low[live]]] = True
            live = live[own < low[live]]
            at[live] += 1
            live = live[at[live] < end[live]]
        return at, same

    def get(self, index: np.ndarray) -> np.ndarray:
        """Members by index."""
        index = np.asarray(index, np.int64)
        ones = 64 * np.arange(len(self.zeros)) - self.zeros.astype(np.int64)
        out = np.empty(len(index), np.uint64)
        for begin in range(0, len(index), _PIECE):
            part = index[begin:begin + _PIECE]
            word = np.searchsorted(ones, part, "right") - 1
            inside = part - ones[word]
            bits = np.unpackbits(self.high[word], axis=1, bitorder="little")
            bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= inside[:, None]).sum(axis=1)
            high = (word * 64 + bit - part).astype(np.uint64)
            out[begin:begin + _PIECE] = (high << np.uint64(self.low_bits)) | self._lows(part)
        return out


CODES = 65534
LOWEST = -14.0


def quantise(log10: np.ndarray) -> np.ndarray:
    """Log probabilities as codes from 1; 0 is kept for what is not there."""
    return (1 + np.rint((np.maximum(log10, LOWEST) / LOWEST) * CODES)).astype("<u2")


def restore(codes: np.ndarray) -> np.ndarray:
    """The log probabilities of codes other than 0."""
    return (codes.astype(np.float64) - 1) * LOWEST / CODES


class Level:
    """Contexts, pointers to their successors, and the successors with probabilities and counts.

    Successors are stored as ``rank of the context * span + word``, so one
    monotone list holds them all and a search is relative to its context.
    """

    def __init__(self, buffer: bytes | mmap.mmap | memoryview) -> None:
        self.span, = struct.unpack_from("<Q", buffer, 0)
        self.contexts = Monotone(buffer, 8)
        self.pointers = Monotone(buffer, self.contexts.end)
        self.successors = Monotone(buffer, self.pointers.end)
        n, at = self.successors.n, self.successors.end
        self.codes = np.frombuffer(buffer, "<u2", n, at)
        self.counts = np.frombuffer(buffer, "<u4", n, at + 2 * n)

    @staticmethod
    def encode(context: np.ndarray, word: np.ndarray, log10: np.ndarray, count: np.ndarray) -> bytes:
        """A level from n-grams sorted by context and word, without repeats."""
        distinct, first, rank = np.unique(context, return_index=True, return_inverse=True)
        span = int(word.max()) + 1 if len(word) else 1
        members = rank.astype(np.uint64) * np.uint64(span) + word.astype(np.uint64)
        return (struct.pack("<Q", span) + Monotone.encode(distinct) + Monotone.encode(np.append(first, len(word)))
                + Monotone.encode(members) + quantise(log10).tobytes() + np.minimum(count, 2**32 - 1).astype("<u4").tobytes())

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each (context, word), or -1; contexts that repeat one after the other are looked up once."""
        out = np.full(len(context), -1, np.int64)
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        rank, known = self.contexts.successor(context[new].astype(np.uint64))
        turn = np.cumsum(new) - 1
        there = np.flatnonzero(known[turn] & (word < self.span))
        at, same = self.successors.successor(rank[turn[there]].astype(np.uint64) * np.uint64(self.span) + word[there].astype(np.uint64))
        out[there[same]] = at[same]
        return out

    def successors_of(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """The words that follow a context, and their log probabilities."""
        rank, known = self.contexts.successor(np.array([context], np.uint64))
        if not known[0]:
            return np.empty(0, np.uint64), np.empty(0)
        begin, end = self.pointers.get(np.array([rank[0], rank[0] + 1])).astype(np.int64)
        return self.successors.get(np.arange(begin, end)) - np.uint64(rank[0] * self.span), restore(self.codes[begin:end])


def mapped(level: bytes) -> Level:
    """A level over an anonymous memory map."""
    area = mmap.mmap(-1, max(len(level), 1))
    area.write(level)
    return Level(area)
