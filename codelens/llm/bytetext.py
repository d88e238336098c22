"""Columnar text work on UTF-8 buffers with numpy: words, word hashes and n-gram hashes of many texts at once.

A column of texts is taken as one byte buffer with offsets (Arrow's own
layout); nothing here loops over words in Python. Work is done slice by slice
(SLICE_BYTES), so memory does not follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _inverse(x: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(x, -1, 1 << 64)


_pow = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base ** i, base ** -i) for i < n, modulo 2**64."""
    if _pow["n"] < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", _inverse(_BASE))):
            x = np.full(size, base & (2**64 - 1), np.uint64)
            x[0] = 1
            _pow[name] = np.multiply.accumulate(x)
        _pow["n"] = size
    return _pow["up"][:n], _pow["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Flat:
    """Texts as one buffer; text i is buf[offsets[i]:offsets[i + 1]]."""

    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def flat(column: pa.Array) -> Flat:
    """A string column (null: empty) as a flat buffer, without a copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return Flat(buf[at[0]: at[-1]], at - at[0])


def slices(texts: Flat, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Flat]]:
    """(first, last + 1, texts) of consecutive texts of about ``limit`` bytes, one text at least."""
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(texts.offsets, texts.offsets[lo] + limit, "right")) - 1)
        at = texts.offsets[lo: hi + 1]
        yield lo, hi, Flat(texts.buf[at[0]: at[-1]], at - at[0])
        lo = hi


#: Byte maps: A-Z lower-cased, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo: hi + 1] = True
    return out


def words(texts: Flat, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of maximal runs of ``inside`` bytes; text i has the words bounds[i]:bounds[i + 1]."""
    mask = inside[texts.buf]
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    full = texts.offsets[:-1] < texts.offsets[1:]
    at = texts.offsets[:-1][full]
    first[at] = mask[at]
    at = texts.offsets[1:][full] - 1
    last[at] = mask[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[starts[i]:ends[i]], spans in order of their starts.

    Differences of prefix sums of a polynomial, moved to the origin by inverse
    powers; done block by block, so memory stays near SLICE_BYTES.
    """
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(starts, base + SLICE_BYTES)))
        top = int(ends[lo:hi].max())
        up, down = _powers(top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((buf[base:top].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)


def rolling_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the ``width`` bytes from each place on; block by block, as ``span_hashes``."""
    n = len(buf) - width + 1
    out = np.empty(max(0, n), np.uint64)
    for lo in range(0, n, SLICE_BYTES):
        hi = min(n, lo + SLICE_BYTES)
        part = buf[lo: hi + width - 1]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        out[lo:hi] = (sums[width:] - sums[:-width]) * down[: hi - lo]
    return mix(out)


def grams(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all n-grams of ``width`` words that lie within one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out = out * _STEP + hashes[j: j + n]
    ok = np.ones(len(hashes) + 1, bool)
    for b in bounds[1:-1] if width > 1 else ():
        ok[max(0, b - width + 1): b] = False
    at = np.flatnonzero(ok[:n])
    return at, mix(out[at])
