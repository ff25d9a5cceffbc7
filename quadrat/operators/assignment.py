"""One-to-one assignment between overlapping boxes: most pairs first, then the highest total IoU."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .runs import by_runs


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """A minimum-cost assignment of all rows of a matrix with no more rows than columns, by shortest augmenting paths."""
    rows, columns = cost.shape
    u, v = np.zeros(rows + 1), np.zeros(columns + 1)
    owner, way = np.zeros(columns + 1, int), np.zeros(columns + 1, int)
    for row in range(1, rows + 1):
        owner[0], at = row, 0
        least, used = np.full(columns + 1, np.inf), np.zeros(columns + 1, bool)
        while owner[at]:
            used[at] = True
            reduced = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = at
            to = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[to]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    return [(int(owner[c]) - 1, c - 1) for c in range(1, columns + 1) if owner[c]]


def components(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The connected component of each edge (a, b) of a two-sided graph."""
    left, x = np.unique(a, return_inverse=True)
    right, y = np.unique(b, return_inverse=True)
    if len(left) == len(a) or len(right) == len(b):  # all nodes of a side have one edge: the other side's nodes are the components
        return y if len(left) == len(a) else x
    root = np.arange(len(left) + y.max(initial=-1) + 1)
    y = y + len(left)
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == root).all():
            return root[x]
        root = after


def assign_edges(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which edges a maximum matching takes: the most edges, then the largest total weight (at most 1 each).

    Components are solved alone. One with a single node on either side takes its heaviest edge (of equal
    ones the first), for all such components at once; the others are small dense problems.
    """
    taken = np.zeros(len(a), bool)
    if not len(a):
        return taken
    part = np.unique(components(a, b), return_inverse=True)[1]
    # a node lies in one component, so a component's nodes are counted at their first edges
    left, right = (np.bincount(part[np.unique(x, return_index=True)[1]], minlength=part.max() + 1) for x in (a, b))
    star = (np.minimum(left, right) == 1)[part]
    edges = np.flatnonzero(star)
    edges = edges[np.lexsort((b[edges], a[edges], -weight[edges], part[edges]))]
    taken[edges[np.unique(part[edges], return_index=True)[1]]] = True
    rest = np.flatnonzero(~star)
    rest = rest[np.argsort(part[rest], kind="stable")]
    for mine in np.split(rest, np.flatnonzero(np.diff(part[rest])) + 1) if len(rest) else ():
        lefts, x = np.unique(a[mine], return_inverse=True)
        rights, y = np.unique(b[mine], return_inverse=True)
        gain = np.zeros((len(lefts), len(rights)))
        edge = np.full(gain.shape, -1)
        gain[x, y] = min(gain.shape) + 1 + weight[mine]
        edge[x, y] = mine
        found = hungarian(-gain) if len(lefts) <= len(rights) else [(i, j) for j, i in hungarian(-gain.T)]
        chosen = np.array([edge[i, j] for i, j in found if edge[i, j] >= 0], int)
        taken[chosen] = True
    return taken


def ordered_edges(frame: pd.DataFrame, keys: list[str], left: str, right: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, a, b): the order of a frame's rows by left and right within its groups, and numbers of the ends of the edges in it.

    The frame is sorted by keys, so groups are runs of rows; no end is in two groups.
    """
    codes = np.stack([pd.factorize(frame[k], use_na_sentinel=False)[0] for k in keys])
    group = np.concatenate([[0], np.cumsum((codes[:, 1:] != codes[:, :-1]).any(axis=0))]).astype(np.int64)[: len(frame)]
    ends = [np.unique(frame[c].to_numpy(), return_inverse=True)[1] for c in (left, right)]
    order = np.lexsort((ends[1], ends[0], group))
    a, b = ((group * (e.max(initial=0) + 1) + e)[order] for e in ends)
    return order, a, b


def match(pairs: DataFrame, keys: list[str], left: str, right: str, iou: str = "iou", carry: list[str] | None = None) -> DataFrame:
    """The pairs that a one-to-one matching takes, in each group of keys.

    pairs holds only allowed pairs, with their IoU. Many groups are solved in one call; the cost of a
    group follows its largest connected component and not the whole image. Which of equally good pairings
    is taken is fixed by the order of left and right, not by the input's order. carry names further
    columns that the taken pairs keep.
    """
    wanted = pairs.select(*keys, left, right, iou, *(carry or []))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        order, a, b = ordered_edges(frame, keys, left, right)
        return frame.iloc[order[assign_edges(a, b, frame[iou].to_numpy(np.float64)[order])]]

    return by_runs(wanted, keys, solve, wanted.schema)
