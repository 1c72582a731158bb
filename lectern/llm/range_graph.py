"""Range search over a graph whose edges go both ways (numpy, inside a task), for operator 7."""

from __future__ import annotations

import numpy as np


def both_ways(n: int, of, to):
    """The edges ``of`` -> ``to`` and back, without repeats, as (begin, ends): node v's neighbours are ends[begin[v]:begin[v + 1]]."""
    key = np.unique(np.concatenate([of * n + to, to * n + of]))
    of, ends = key // n, key % n
    return np.searchsorted(of, np.arange(n + 1)), ends


def range_search(x, begin, ends, queries, entries, least):
    """(query row, id) pairs of unit vectors with inner product >= ``least`` (one number, or one for each id).

    The queries go together: from all their entries, whatever lies in range of any of them is expanded,
    and each vector met is compared with every query, as a product of matrices. Edges are as ``both_ways`` gives them.
    """
    n, q = len(x), len(queries)
    least = np.broadcast_to(np.asarray(least), (n,))
    met, inside = np.zeros(n, bool), np.zeros((q, n), bool)
    front = np.unique(entries)
    while len(front):
        met[front] = True
        near = queries @ x[front].T >= least[front]
        inside[:, front] = near
        go = front[near.any(axis=0)]
        size = begin[go + 1] - begin[go]
        around = ends[np.repeat(begin[go] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        around = np.unique(around)
        front = around[~met[around]]
    return np.nonzero(inside)
