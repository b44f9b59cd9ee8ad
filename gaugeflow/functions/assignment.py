"""Optimal one-to-one matching of two lists.

Of all assignments of the largest total, to within ``NEAR``, the
lexicographically least is taken: the first row gets the least column that
some such assignment gives it, then the second, and so on; a row without
partner counts as if its column were past the last. Where each element of the
shorter side has a best partner of its own, that is the only optimum. Of the
others, small matrices of one shape are settled together by comparing all
assignments; larger ones by shortest augmenting paths, whose duals show which
cells other optimal assignments can use.
"""

from __future__ import annotations

import ast
import itertools
import math
from collections import deque
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Any

import numpy as np

#: Totals this close are equal.
NEAR = 1e-9
#: Matrices with up to this many assignments are settled by comparing them all, so many sums at a time.
ENUMERATED = 5040
SUMS = 1 << 21


# ---------------------------------------------------------------- small matrices

@lru_cache(maxsize=256)
def _maps(n: int, m: int) -> np.ndarray:
    """All assignments of n rows to m columns in lexicographic order; ``m`` for a row without partner."""
    if n <= m:
        return np.array(list(itertools.permutations(range(m), n)), np.int64).reshape(-1, n)
    rows = np.array(list(itertools.permutations(range(n), m)), np.int64).reshape(-1, m)
    maps = np.full((len(rows), n), m, np.int64)
    np.put_along_axis(maps, rows, np.broadcast_to(np.arange(m), rows.shape), axis=1)
    return maps[np.lexsort(maps.T[::-1])]


def solve_stack(stack: np.ndarray) -> np.ndarray:
    """The column of each row, or their number without partner, for matrices of one shape (count, n, m)."""
    count, n, m = stack.shape
    if not n or not m:
        return np.full((count, n), m, np.int64)
    settled, out = _own_best(stack)
    if not settled.all():
        out[~settled] = _solve_open(stack[~settled])
    return out


def _own_best(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which matrices are settled, columns): those whose shorter side's elements each have one best partner, no two the same.

    Any other assignment has a lesser partner somewhere and nowhere a better
    one. Partners that are nearly as good leave a matrix open.
    """
    count, n, m = stack.shape
    side = 2 if n <= m else 1
    near = stack >= stack.max(axis=side, keepdims=True) - 2 * NEAR
    settled = (near.sum(axis=side) == 1).all(axis=1) & (near.sum(axis=3 - side) <= 1).all(axis=1)
    return settled, np.where(near.any(axis=2), near.argmax(axis=2), m)


def _solve_open(stack: np.ndarray) -> np.ndarray:
    count, n, m = stack.shape
    if math.perm(max(n, m), min(n, m)) > ENUMERATED:
        return np.array([_solve_large(s) for s in stack], np.int64).reshape(count, n)
    maps = _maps(n, m)
    padded = np.concatenate([stack, np.zeros((count, n, 1))], axis=2)
    out = np.empty((count, n), np.int64)
    for a in range(0, count, step := max(1, SUMS // len(maps))):
        part = padded[a : a + step]
        totals = part[:, 0, maps[:, 0]]
        for i in range(1, n):
            totals = totals + part[:, i, maps[:, i]]
        out[a : a + step] = maps[(totals >= totals.max(axis=1, keepdims=True) - NEAR).argmax(axis=1)]
    return out


# ---------------------------------------------------------------- large matrices

def _shortest_paths(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each row, u, v) of a cheapest assignment of all rows; there are no fewer columns.

    ``u`` and ``v`` are the duals: ``cost - u - v`` is nowhere below zero, and
    zero where an optimal assignment can lie; ``v`` is zero for free columns.
    """
    n, m = cost.shape
    u, v = cost.min(axis=1), np.zeros(m)
    column, row = np.full(n, -1), np.full(m, -1)
    for i in range(n):
        j = int(((cost[i] == u[i]) & (row < 0)).argmax())
        if row[j] < 0 and cost[i, j] == u[i]:
            column[i], row[j] = j, i
    for start in np.flatnonzero(column < 0):
        far = cost[start] - u[start] - v
        before, done = np.full(m, start), np.zeros(m, bool)
        open_far = far.copy()
        while True:
            j = int(open_far.argmin())
            low = open_far[j]
            done[j], open_far[j] = True, np.inf
            if row[j] < 0:
                break
            i = row[j]
            through = low + cost[i] - u[i] - v
            better = ~done & (through < far)
            far[better] = open_far[better] = through[better]
            before[better] = i
        met = np.flatnonzero(done & (row >= 0))
        u[row[met]] += low - far[met]
        v[met] += far[met] - low
        u[start] += low
        while True:
            i = before[j]
            row[j] = i
            column[i], j = j, column[i]
            if i == start:
                break
    return column, u, v


def _solve_large(similarity: np.ndarray) -> np.ndarray:
    n, m = similarity.shape
    cost = -similarity.astype(float)
    if n <= m:
        match, u, v = _shortest_paths(cost)
        free = v >= -NEAR
    else:
        rows, v, u = _shortest_paths(np.ascontiguousarray(cost.T))
        match = np.full(n, m)
        match[rows] = np.arange(m)
        free = u >= -NEAR
    return _least(cost - u[:, None] - v <= NEAR, free, match)


def _least(tight: np.ndarray, free: np.ndarray, match: np.ndarray) -> np.ndarray:
    """The lexicographically least of the optimal assignments, which lie on ``tight`` cells.

    ``free``: which of the longer side may stay without partner. A row takes
    a smaller column if those that it drives out, one after the other, can end
    at the column that it gave up.
    """
    n, m = tight.shape
    owner = np.full(m, -1)
    owner[match[match < m]] = np.flatnonzero(match < m)
    for i in range(n):
        for j in np.flatnonzero(tight[i, : match[i]]):
            if 0 <= owner[j] < i:
                continue
            moves = _driven_out(tight, free, match, owner, i, j)
            if moves is not None:
                for k, c in moves:
                    if k >= 0:
                        match[k] = c
                    if c < m:
                        owner[c] = k
                match[i], owner[j] = j, i
                break
    return match


def _driven_out(tight, free, match, owner, i: int, j: int) -> list[tuple[int, int]] | None:
    """Moves (row, column) by which column ``j`` becomes free for row ``i``; row -1 stands for what free columns have, column m for none."""
    n, m = tight.shape
    target = int(match[i])
    seen = (owner >= 0) & (owner < i)
    seen[j] = True
    start = int(owner[j])
    came: dict[int, tuple[int, int] | None] = {start: None}
    queue = deque([start])
    resting = False
    while queue:
        node = queue.popleft()
        own = tight[node] if node >= 0 else free
        alone = n > m and node >= 0 and free[node]
        if own[target] if target < m else alone:
            moves, at = [], target
            while True:
                moves.append((node, at))
                if came[node] is None:
                    return moves
                node, at = came[node]
        columns = np.flatnonzero(own & ~seen)
        seen[columns] = True
        nexts = [(int(owner[c]), int(c)) for c in columns]
        if alone and not resting:
            resting = True
            nexts += [(int(r), m) for r in np.flatnonzero(match == m) if r > i]
        for k, c in nexts:
            if k != i and k not in came:
                came[k] = (node, c)
                queue.append(k)
    return None


# ---------------------------------------------------------------- lists

def assign(similarity: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-similarity assignment, in order of rows."""
    n = len(similarity)
    m = len(similarity[0]) if n else 0
    if not n or not m:
        return []
    if n == m == 1:
        return [(0, 0)]
    # As ``_own_best``, for one small matrix without arrays.
    lines = similarity if n <= m else list(zip(*similarity))
    own = []
    for line in lines if n * m <= 256 else []:
        least = max(line) - 2 * NEAR
        near = [k for k, s in enumerate(line) if s >= least]
        if len(near) != 1:
            break
        own += near
    if len(set(own)) == len(lines):
        return list(enumerate(own)) if n <= m else sorted((i, j) for j, i in enumerate(own))
    match = solve_stack(np.asarray(similarity, float)[None])[0]
    return [(i, int(j)) for i, j in enumerate(match) if j < m]


def solve_ragged(rows: np.ndarray, cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, i, j, score) of the pairs of many matrices, given as Arrow has nested lists.

    ``rows``: offsets of each matrix's rows, ``cells``: offsets of each row's
    cells in ``values``. Matrices of one shape are solved together. A single
    cell of 0 is no pair.
    """
    n = np.diff(rows)
    first = cells[rows[:-1]]
    m = np.where(n > 0, cells[np.minimum(rows[:-1] + 1, len(cells) - 1)] - first, 0)
    pairs = np.minimum(n, m)
    single = (n == 1) & (m == 1)
    pairs[single] = values[first[single]] > 0
    offsets = np.concatenate([[0], np.cumsum(pairs)])
    i_of, j_of = np.zeros(offsets[-1], np.int32), np.zeros(offsets[-1], np.int32)
    score = np.zeros(offsets[-1])
    at = np.flatnonzero(single & (pairs == 1))
    score[offsets[at]] = values[first[at]]
    open_ = (pairs > 0) & ~single
    shapes = n * (int(m.max(initial=0)) + 1) + m
    for shape in np.unique(shapes[open_]):
        own = np.flatnonzero(open_ & (shapes == shape))
        a, b = int(n[own[0]]), int(m[own[0]])
        stack = values[first[own][:, None] + np.arange(a * b)].reshape(len(own), a, b)
        match = solve_stack(stack)
        k, i = np.nonzero(match < b)
        place = (offsets[own][:, None] + np.arange(min(a, b))).ravel()
        i_of[place], j_of[place], score[place] = i, match[k, i], stack[k, i, match[k, i]]
    return offsets, i_of, j_of, score


def normalised(value: Any) -> Any:
    """List elements before comparison: null is empty, scalars are lower-case text with single spaces."""
    if value is None:
        return ""
    if isinstance(value, (dict, list)):
        return value
    return " ".join(str(value).lower().split())


def match_lists(a: Sequence[Any], b: Sequence[Any], compare: Callable[[Any, Any], float]) -> list[tuple[int, int, float]]:
    """Pairs (i, j, similarity). A single element on each side is a pair only if the two are alike at all."""
    if not a or not b:
        return []
    matrix = [[compare(x, y) for y in b] for x in a]
    if len(a) == len(b) == 1:
        return [(0, 0, matrix[0][0])] if matrix[0][0] > 0 else []
    return [(i, j, matrix[i][j]) for i, j in assign(matrix)]


def list_metrics(a: Sequence[Any], b: Sequence[Any], compare: Callable[[Any, Any], float], threshold: float = 0.7) -> dict[str, Any]:
    """tp, fp, fn, precision, recall and f1 of matching predictions ``b`` with truths ``a``."""
    a, b = [normalised(x) for x in a], [normalised(x) for x in b]
    n, m = len(a), len(b)
    pairs = match_lists(a, b, compare)
    if not n and not m:
        tp, precision, recall = 0, 1.0, 1.0
    else:
        tp = len(pairs) if n == m == 1 else sum(s >= threshold for _, _, s in pairs)
        precision = tp / m if m else 1.0 if not n else 0.0
        recall = tp / n if n else 1.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return {"tp": tp, "fp": m - tp, "fn": n - tp, "precision": precision, "recall": recall, "f1": f1, "matched_pairs": pairs}


def as_list(value: Any) -> list[Any]:
    """A list from any value: text like a list is read as one, anything else is a list of itself."""
    if isinstance(value, str) and value.startswith("[") and value.endswith("]"):
        try:
            value = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            # Not a list after all.
            pass
    return value if isinstance(value, list) else [value]


def binary_compare(a: Any, b: Any, compare: Callable[[Any, Any], float], threshold: float = 0.7) -> tuple[int, int]:
    """(tp, fp) of two lists, or of values that stand for lists."""
    found = list_metrics(as_list(a), as_list(b), compare, threshold)
    return found["tp"], found["fp"]


def matching_info(a: Sequence[Any], b: Sequence[Any], compare: Callable[[Any, Any], float], threshold: float = 0.7) -> dict[str, Any]:
    """Pairs with scores, pairs alone, and which indices of either side are in a pair and which are not."""
    pairs = list_metrics(a or [], b or [], compare, threshold)["matched_pairs"] if a and b else []
    left, right = {i for i, _, _ in pairs}, {j for _, j, _ in pairs}
    return {
        "matched_pairs": pairs,
        "assignments": [(i, j) for i, j, _ in pairs],
        "unmatched_gt_indices": [i for i in range(len(a or [])) if i not in left],
        "unmatched_pred_indices": [j for j in range(len(b or [])) if j not in right],
        "matched_gt_indices": left,
        "matched_pred_indices": right,
    }
