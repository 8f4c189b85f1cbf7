"""Words of whole Arrow batches as numpy arrays: a few passes over the bytes, no Python object per word.

Words are told apart by a 64-bit hash of their bytes (polynomial, then mixed). Texts are UTF-8 and all separators are ASCII,
so bytes may be looked at without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE = 1 << 20
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

#: ASCII white space separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds from 0) of runs of whole texts of about ``limit`` bytes."""
    data, bounds = utf8(column)
    first, rows = 0, len(bounds) - 1
    while first < rows:
        end = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        end = min(rows, max(end, first + 1))
        yield first, end, data[bounds[first]:bounds[end]], bounds[first:end + 1] - bounds[first]
        first = end


@dataclass
class Words:
    """Words of a run of texts. ``at[i]`` to ``at[i + 1]`` are those of text i; starts and ends are byte positions."""

    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.at[i]:self.at[i + 1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def spans(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that stay inside one text."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    edge = bounds[:-1]
    before[edge[edge < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    edge = bounds[1:]
    after[edge[edge > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    n = len(data)
    power, inverse = _powers(max(SLICE * 2, 1 << int(n + 1).bit_length()))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False, separator: np.ndarray = SPACE) -> Words:
    """Words of a run of texts, as ``slices`` yields them."""
    starts, ends = spans(~separator[data], bounds)
    return Words(hash_spans(LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, bounds), starts, ends)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for i in range(1, k):
        h = h * np.uint64(0x2545F4914F6CDD1D) + hashes[i:i + n]
    return mix(h)
