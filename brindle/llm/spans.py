"""Numpy over the bytes of many texts at once: words and 64-bit names of byte ranges.

A name is a polynomial in random values of the bytes, mixed; equal ranges have equal names, and different ones differ
but for a chance of about 2 to the power -64 a pair.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, one text after the other, and where each begins (and the last ends)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


class Powers:
    """Powers of the base and of its inverse, as many as have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", BASE), ("down", UNBASE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


def range_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit names of the byte ranges."""
    powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers.up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, texts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes that stay in one text, and the number of words before each text."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    begins = texts[:-1][texts[:-1] < len(data)]
    cut = np.zeros(len(data) + 1, bool)
    cut[begins] = True
    starts = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, texts)
