"""Vectorised scanning of UTF-8 text columns.

The operators of this subpackage work on whole Arrow batches: the bytes of every text of a
batch lie in one buffer, so words, word hashes and rolling window hashes are a few numpy
passes over that buffer, without a Python object for any word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These separators are ASCII,
so cutting the bytes cuts the code points too. A null text has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

BASE = np.uint64(0x9E3779B97F4A7C55)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
WINDOW_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

HASH_BYTES = 1 << 19

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the life of the worker."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length()) if n > 1 else 1024
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = have[filled - 1] * base
            have[filled : 2 * filled] = have[: min(filled, size - filled)] * step
            filled *= 2
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Scan:
    """The words of a run of texts: text k has the words ptr[k] to ptr[k+1]."""

    data: np.ndarray  # uint8, all texts end to end
    offsets: np.ndarray  # int64, of the texts in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    ptr: np.ndarray

    def word_hashes(self) -> np.ndarray:
        """64 bits for each word, equal for equal words wherever they stand.

        Worked out for the words that start within HASH_BYTES of each other at a time, and in parts for
        longer words, so the sums and the table of powers stay small however long a text is."""
        lengths = self.ends - self.starts
        out = np.empty(len(self.starts), dtype=np.uint64)
        long = np.append(np.flatnonzero(lengths > HASH_BYTES), len(out))
        first = 0
        while first < len(out):
            if first == long[0]:
                out[first] = _long_hash(self.data[self.starts[first] : self.ends[first]])
                long, first = long[1:], first + 1
                continue
            last = min(int(np.searchsorted(self.starts, self.starts[first] + HASH_BYTES)), int(long[0]))
            base = self.starts[first]
            part = self.data[base : self.ends[last - 1]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODES[part] * powers(BASE, len(part)), out=sums[1:])
            begin, end = self.starts[first:last] - base, self.ends[first:last] - base
            out[first:last] = (sums[end] - sums[begin]) * powers(BASE_INVERSE, len(part))[begin]
            first = last
        return mix(out ^ lengths.astype(np.uint64))

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.ptr))


def _long_hash(word: np.ndarray) -> int:
    """The sum of the codes of a word's bytes times the powers of BASE, in parts of HASH_BYTES."""
    total, step = 0, pow(int(BASE), HASH_BYTES, 1 << 64)
    for k in reversed(range(0, len(word), HASH_BYTES)):
        part = word[k : k + HASH_BYTES]
        total = (total * step + int((BYTE_CODES[part] * powers(BASE, len(part))).sum(dtype=np.uint64))) % (1 << 64)
    return total


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts; a null text is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, (at - at[0] if len(at) else np.zeros(1, np.int64))


def scan(data: np.ndarray, offsets: np.ndarray) -> Scan:
    """Find the words of the texts that lie at the offsets in data."""
    inside = ~SEPARATOR[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Scan(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def scan_column(column: pa.Array) -> Scan:
    return scan(*text_buffers(column))


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut the texts at these offsets into runs of about `most` bytes; one long text is one run."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        out.append((first, last))
        first = last
    return out


def window_hashes(values: np.ndarray, ptr: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash each run of `width` consecutive values inside one text; also where the runs start."""
    n = len(values)
    lengths = np.diff(ptr)
    counts = np.maximum(lengths - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.repeat(ptr[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
    base = WINDOW_BASES[which]
    weights = powers(base, width)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out += values[k : n - width + 1 + k] * weights[k]
    return mix(out[first]), first
