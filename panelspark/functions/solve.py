"""Small dense algebra on packed Gram matrices; runs inside pandas UDFs on aggregated rows only.

A Gram matrix of m columns is packed as its upper triangle, row by row.
"""

from __future__ import annotations

import numpy as np


def triangle(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def unpack(packed, m: int) -> np.ndarray:
    """(B, m, m) symmetric matrices from B packed rows."""
    rows = np.stack([np.asarray(p, dtype=float) for p in packed]) if len(packed) else np.zeros((0, m * (m + 1) // 2))
    out = np.zeros((len(rows), m, m))
    i, j = np.triu_indices(m)
    out[:, i, j] = rows
    out[:, j, i] = rows
    return out


def scaled_inverse(a: np.ndarray, rcond: float = 1e-11) -> np.ndarray:
    """Pseudo-inverse of each symmetric matrix after scaling its diagonal to one."""
    d = np.sqrt(np.einsum("bii->bi", a))
    d = np.where(d > 0, d, 1.0)
    d = d[:, :, None] * d[:, None, :]
    return np.linalg.pinv(a / d, rcond=rcond, hermitian=True) / d


def least_squares(gram: np.ndarray, xs: list[int], y: int, rcond: float = 1e-11):
    """Coefficients, residual sum of squares and inverse of X'X for each matrix.

    Columns are scaled to unit length first; the pseudo-inverse takes care of rank loss (smallest-norm solution).
    """
    a = gram[:, xs][:, :, xs]
    r = gram[:, xs, y]
    inv = scaled_inverse(a, rcond)
    beta = np.einsum("bij,bj->bi", inv, r)
    rss = gram[:, y, y] - 2 * np.einsum("bi,bi->b", beta, r) + np.einsum("bi,bij,bj->b", beta, a, beta)
    return beta, np.maximum(rss, 0.0), inv


def none_if_nan(v):
    return None if v is None or not np.isfinite(v) else float(v)
