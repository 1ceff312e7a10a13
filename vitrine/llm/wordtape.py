"""Words of Arrow text columns as numpy arrays: boundaries and 64-bit hashes of a whole batch at once.

A batch's UTF-8 buffer is read as it lies in memory; no Python string is made. A null text counts as empty. Batches are
handled in slices of whole texts of about `SLICE_BYTES`, and hashes in runs of words of that size, so memory is a small
multiple of the slice or of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Words longer than this are hashed by a cryptographic digest.
LONG_WORD = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_class(pattern_bytes: bytes) -> np.ndarray:
    """A table of 256 flags, true for the given byte values."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: `[^\x20\x09-\x0D]`
NOT_SPACE = ~byte_class(bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(_STEP, SLICE_BYTES + 4 * LONG_WORD)
_INVERSES = powers(_BACK, SLICE_BYTES + 4 * LONG_WORD)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tape:
    """Words of several texts: byte bounds, and the first word of each text (with the total at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + SLICE_BYTES, "right")))
            starts, ends = self.starts[at:to] - base, self.ends[at:to] - base
            if ends[-1] <= SLICE_BYTES:
                total = np.zeros(ends[-1] + 1, np.uint64)
                np.cumsum(_BYTE_CODES[self.data[base : base + ends[-1]]] * _POWERS[: ends[-1]], out=total[1:])
                out[at:to] = mixed((total[ends] - total[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))
            for i in np.flatnonzero(ends - starts > LONG_WORD):
                word = self.data[base + starts[i] : base + ends[i]].tobytes()
                out[at + i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            at = to
        return out


def tape(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> Tape:
    """Words are maximal runs of `word_bytes` inside one text; text i is data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = inside[inner]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Tape(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive hashes; entry i covers [i, i + width)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = powers(np.uint64(0xD1342543DE82EF95), width)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * factor[k]
    return mixed(total)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of arange(first[i], first[i] + count[i])."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(first - before, count)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.empty(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: first row, row after the last, their bytes, and offsets into these."""
    data, offsets = text_buffer(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
