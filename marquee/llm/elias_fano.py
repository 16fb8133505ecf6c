"""Elias-Fano coded ascending integers with bounded-time access to the i-th value.

A value's low bits are stored as they are; its high bits are stored in unary in
a bit vector with one 1 per value, so value i has high part select1(i) - i.  The
select structure (after Okanohara and Sadakane, 2007) has the position of every
SAMPLE-th one; a lookup starts there and counts ones in the next words.  Where the
SAMPLE ones of a stretch spread over more than LONG bits, their positions are stored
one by one, so no lookup reads more than LONG bits.  The whole takes about
2 + log2(u/n) bits per value, with u the largest and n the number of values, and at
most 1.5 bits more for the stretches.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
LONG = 64 * SAMPLE
_HEAD = struct.Struct("<QQIIQ")
_DENSE = np.uint32(0xFFFFFFFF)


def encode(values: np.ndarray) -> bytes:
    """Bytes of an ascending array of non-negative integers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(width)).astype(np.int64)
    ones = high + np.arange(n)
    upper = np.zeros((int(ones[-1]) // 64 + 1 if n else 0) * 64, np.uint8)
    upper[ones] = 1
    upper_bytes = np.packbits(upper, bitorder="little").tobytes()
    shifts = np.arange(width, dtype=np.uint64)
    lower = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    lower_bytes = np.packbits(lower, bitorder="little").tobytes() + b"\0" * 8
    samples = ones[::SAMPLE].astype("<u8")
    long = [k for k in range(len(samples)) if ones[min(n, (k + 1) * SAMPLE) - 1] - ones[k * SAMPLE] > LONG]
    places = np.full(len(samples), _DENSE, "<u4")
    places[long] = np.arange(len(long))
    spread = np.zeros((len(long), SAMPLE), "<u4")
    for row, k in zip(spread, long):
        part = ones[k * SAMPLE : (k + 1) * SAMPLE]
        row[: len(part)] = part - part[0]
    head = _HEAD.pack(n, len(upper_bytes), len(lower_bytes), width, len(long))
    return b"".join([head, samples.tobytes(), places.tobytes(), spread.tobytes(), upper_bytes, lower_bytes])


class EliasFano:
    """Reads ``encode``'s bytes without unpacking them."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, upper, lower, self.width, long = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        samples = (self.n + SAMPLE - 1) // SAMPLE
        self.samples = np.frombuffer(data, "<u8", samples, at)
        at += samples * 8
        self.places = np.frombuffer(data, "<u4", samples, at)
        at += samples * 4
        self.spread = np.frombuffer(data, "<u4", long * SAMPLE, at).reshape(long, SAMPLE)
        at += long * SAMPLE * 4
        self.upper = np.frombuffer(data, "<u8", upper // 8, at)
        at += upper
        self.lower = np.frombuffer(data, np.uint8, lower, at)
        self.end = at + lower

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        bit = i * self.width
        raw = int.from_bytes(self.lower[bit // 8 : bit // 8 + 9].tobytes(), "little")
        return (raw >> (bit % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Position of the i-th one (from 0) of the upper bits."""
        k, left = divmod(i, SAMPLE)
        start = int(self.samples[k])
        if self.places[k] != _DENSE:
            return start + int(self.spread[self.places[k], left])
        word = start // 64
        bits = int(self.upper[word]) >> (start % 64) << (start % 64)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.upper[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self.select(i) - i) << self.width) | self._low(i)

    def to_numpy(self) -> np.ndarray:
        """All values, for sequential readers."""
        ones = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64)
        if not self.width:
            return high
        bits = np.unpackbits(self.lower, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
        return (high << self.width) | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
