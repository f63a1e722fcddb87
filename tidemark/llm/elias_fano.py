"""Elias-Fano code of a non-decreasing sequence, with a select structure."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
HEAD = "<QQBQ"  # values, universe, low bits, bytes of the high part


class EliasFano:
    """``n`` values in 0..universe in about 2 + log2(universe / n) bits each.

    The low bits of all values stand side by side; the high parts are one bit
    string with bit (high + i) set for value i.  ``samples`` has the place of every
    64th set bit, 32 bits each, and is stored with them, so ``run`` reads only the
    bytes from the sample before its first value to the one behind its last.
    """

    def __init__(self, n: int, universe: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low, self.lows, self.highs, self.samples = n, universe, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, universe, low, np.packbits(lows.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"),
                   high[::SAMPLE].astype("<u4"))

    def run(self, first: int, last: int) -> np.ndarray:
        """Select: values first to last - 1."""
        if first >= last:
            return np.zeros(0, np.uint64)
        start, behind = int(self.samples[first // SAMPLE]), (last - 1) // SAMPLE + 1
        end = int(self.samples[behind]) // 8 + 1 if behind < len(self.samples) else len(self.highs)
        bits = np.unpackbits(self.highs[start // 8:end], bitorder="little")
        bits[:start % 8] = 0  # bits of values before the sample
        skip = first % SAMPLE
        high = (np.flatnonzero(bits)[skip:skip + last - first] + start // 8 * 8 - np.arange(first, last)).astype(np.uint64)
        begin, size = first * self.low, (last - first) * self.low
        lows = np.unpackbits(self.lows[begin // 8:(begin + size + 7) // 8], bitorder="little")[begin % 8:begin % 8 + size]
        lows = lows.reshape(last - first, self.low).astype(np.uint64)
        return (high << np.uint64(self.low)) | (lows << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def value(self, i: int) -> int:
        """Select: value i alone."""
        return int(self.run(i, i + 1)[0])

    def values(self) -> np.ndarray:
        return self.run(0, self.n)

    def to_bytes(self) -> bytes:
        return struct.pack(HEAD, self.n, self.universe, self.low, len(self.highs)) + self.highs.tobytes() + self.lows.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """(the code that starts at ``at``, where it ends)"""
        n, universe, low, size = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        highs = np.frombuffer(data, np.uint8, size, at)
        lows = np.frombuffer(data, np.uint8, (n * low + 7) // 8, at + size)
        at += size + len(lows)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        return cls(n, universe, low, lows, highs, samples), at + 4 * len(samples)
