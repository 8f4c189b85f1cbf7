"""Pointer sort: places of terms in a byte buffer, sorted by what stands there. Nothing but pointers moves."""

from __future__ import annotations

import numpy as np

#: Pointers that one pass sorts at once; more are parted around a pivot first.
CACHED = 1 << 16


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each span from ``depth`` on as one big-endian number, zeros beyond its end. ``data`` has 8 bytes to spare."""
    at = starts + depth
    left = ends - at
    view = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))
    out = view[np.minimum(at, len(view) - 1)].astype(np.uint64)
    shift = (8 * (8 - np.clip(left, 1, 8))).astype(np.uint64)
    out = (out >> shift) << shift
    out[left <= 0] = 0
    return out


def multikey_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cached: int = CACHED) -> tuple[np.ndarray, np.ndarray]:
    """(pointers in the order of their spans, stable; whether each differs from the one before).

    Multikey quicksort with characters of eight bytes: a slice is parted into less, equal and more at its depth, the equal part goes one
    character deeper, small slices are sorted character by character. No span may hold a zero byte.
    """
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    order, new = np.arange(len(starts)), np.zeros(len(starts), bool)
    new[:1] = True
    slices = [(0, len(starts), 0)]
    while slices:
        a, b, depth = slices.pop()
        if b - a < 2:
            continue
        part = order[a:b]
        c = characters(data, starts[part], ends[part], depth)
        if b - a <= cached:
            order[a:b], new[a + 1:b] = _small(data, starts, ends, part, c, depth)
            continue
        pivot = np.sort(c[::max(1, len(c) // 101)])[len(c[::max(1, len(c) // 101)]) // 2]
        less, more = c < pivot, c > pivot
        same = ~(less | more)
        order[a:b] = np.concatenate([part[less], part[same], part[more]])
        at = a + int(less.sum())
        end = at + int(same.sum())
        new[at] = True
        if end < b:
            new[end] = True
        slices.append((a, at, depth))
        slices.append((end, b, depth))
        if int(pivot) & 255:  # a last byte of zero ends the span
            slices.append((at, end, depth + 8))
    return order, new


def _small(data, starts, ends, part, c, depth) -> tuple[np.ndarray, np.ndarray]:
    """Order of a small slice and, from its second pointer on, whether each differs from the one before."""
    o = np.argsort(c, kind="stable")
    part, c = part[o], c[o]
    new = np.ones(len(part), bool)
    new[1:] = c[1:] != c[:-1]
    group = np.cumsum(new)
    open_ = np.flatnonzero((c & np.uint64(255)) != 0)
    while len(open_):
        # only runs of two or more go on
        size = np.bincount(group[open_])
        open_ = open_[size[group[open_]] > 1]
        depth += 8
        sub = part[open_]
        c = characters(data, starts[sub], ends[sub], depth)
        o = np.lexsort((c, group[open_]))
        part[open_], c = sub[o], c[o]
        g = group[open_]
        change = np.ones(len(open_), bool)
        change[1:] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        new[open_] |= change
        fresh = np.cumsum(new)
        group[open_] = fresh[open_]
        open_ = open_[(c & np.uint64(255)) != 0]
    return part, new[1:]
