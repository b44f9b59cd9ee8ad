"""Rank agreement of many short or long lists at once, by counting inversions."""

from __future__ import annotations

import numpy as np


def inversions(values: np.ndarray) -> np.ndarray:
    """For each element how many larger ones stand before it, in O(n log^2 n).

    Halves of blocks meet, the blocks doubling: all left halves are sorted
    together, and every element of a right half looks up its place in its own.
    """
    n = len(values)
    out, at = np.zeros(n, np.int64), np.arange(n)
    if not n:
        return out
    base = values - values.min()
    top = int(base.max()) + 1
    width = 1
    while width < n:
        block, right = at // (2 * width), at // width % 2 == 1
        left = np.sort(block[~right] * top + base[~right])
        below = np.searchsorted(left, block[right] * top + base[right], side="right")
        # A right half has elements only if its left half is full.
        out[right] += (block[right] + 1) * width - below
        width *= 2
    return out


def _ties(group: np.ndarray, new: np.ndarray, groups: int) -> np.ndarray:
    """Pairs of equal neighbours in each group; ``new`` marks where a run of equal values begins."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    return np.bincount(group[first], size * (size - 1) / 2, minlength=groups)


def agreement(offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(agreeing less disagreeing pairs, pairs tied in x, pairs tied in y) of each list of points."""
    groups = len(offsets) - 1
    group = np.repeat(np.arange(groups), np.diff(offsets))
    if not len(group):
        return np.zeros(groups), np.zeros(groups), np.zeros(groups)
    by_y = np.lexsort((y, group))
    new_y = np.concatenate([[True], (y[by_y][1:] != y[by_y][:-1]) | (group[1:] != group[:-1])])
    ty = _ties(group, new_y, groups)
    # Ranks of y go on from group to group, so that no pair of two groups is an inversion.
    rank = np.empty(len(y), np.int64)
    rank[by_y] = np.cumsum(new_y)
    order = np.lexsort((rank, x, group))
    xs, rs = x[order], rank[order]
    new_x = np.concatenate([[True], (xs[1:] != xs[:-1]) | (group[1:] != group[:-1])])
    tx, txy = _ties(group, new_x, groups), _ties(group, new_x | np.concatenate([[True], rs[1:] != rs[:-1]]), groups)
    wrong = np.bincount(group, inversions(rs), minlength=groups)
    n = np.diff(offsets).astype(float)
    return n * (n - 1) / 2 - tx - ty + txy - 2 * wrong, tx, ty
