"""Vectorised words, word hashes and window hashes of a piece of texts.

A word is `[^\\x20\\x09-\\x0D]+`. Its blanks are single bytes in UTF-8, so all work is on bytes. Hashes
are polynomials over wrapping 64-bit integers, taken from prefix sums and then mixed; two of them with
different bases give 128 bits. They are the same in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[tuple[int, int], np.ndarray] = {}


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), wrapping."""
    have = _powers.get((base, 0))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[(base, 0)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over the whole word."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of values[start:end] for each range, equal for equal ranges wherever they lie."""
    base = int(BASES[which])
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(base, n), dtype=np.uint64, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power(_inverse(base), n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


@dataclass
class Words:
    data: np.ndarray      # bytes of all texts, one after the other
    offsets: np.ndarray   # where each text starts, and the end
    starts: np.ndarray    # byte range of each word
    ends: np.ndarray
    bounds: np.ndarray    # index of the first word of each text, and the number of words

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, words, "right") - 1

    def hashes(self, which: int = 0) -> np.ndarray:
        return ranges_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, which)

    def windows(self, length: int, hashes: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of `length` words within one text, and the windows' hashes."""
        n = len(self.starts)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.arange(n - length + 1)
        last_text = np.repeat(np.arange(self.texts), np.diff(self.bounds))
        first = first[last_text[first] == last_text[first + length - 1]]
        return first, ranges_hash(hashes, first, first + length, which)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each text; NULL counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def split_words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = column_bytes(column)
    if lower:
        data = LOWER[data]
    inside = ~BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))
