"""Least-cost matching of two small sets of centres."""

from __future__ import annotations

from itertools import permutations

import numpy as np


def cost_matrix(reference: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.sqrt(((reference[:, None, :] - other[None, :, :]) ** 2).sum(2))


def match(cost: np.ndarray) -> list[int]:
    """``m[i]``, the column matched to row i, of least total cost.

    Up to six rows every matching is tried and the first in lexicographic order wins ties; beyond, shortest augmenting
    paths are used.
    """
    n = len(cost)
    if n <= 6:
        return list(min(permutations(range(n)), key=lambda p: (round(sum(cost[i, p[i]] for i in range(n)), 12), p)))
    row_price, col_price = np.zeros(n), np.zeros(n + 1)
    row_of = np.full(n + 1, -1)
    for i in range(n):
        row_of[n], col = i, n
        slack, came = np.full(n, np.inf), np.full(n, n)
        done = np.zeros(n + 1, bool)
        while row_of[col] != -1:
            done[col] = True
            r = row_of[col]
            free = ~done[:n]
            reduced = cost[r] - row_price[r] - col_price[:n]
            better = free & (reduced < slack)
            slack[better], came[better] = reduced[better], col
            nxt = int(np.where(free, slack, np.inf).argmin())
            step = slack[nxt]
            used = np.flatnonzero(done)
            row_price[row_of[used]] += step
            col_price[used] -= step
            slack[free] -= step
            col = nxt
        while col != n:
            row_of[col] = row_of[came[col]]
            col = came[col]
    out = [0] * n
    for c in range(n):
        out[row_of[c]] = c
    return out


def align(reference: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``other``'s rows in the order of the reference rows they match."""
    return other[match(cost_matrix(reference, other))]
