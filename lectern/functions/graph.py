"""A robust-pruned directed graph over the vectors of one shard (numpy, inside a task; at most a few thousand vectors)."""

from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, ALPHA, BATCH, STEP = 32, 64, 1.2, 256, 4
NONE = -1


def beam_search(x, norms, neighbours, queries, entries, beam: int, step: int = STEP):
    """Greedy search from ``entries`` (q x e ids): ids and squared distances of the ``beam`` nearest met, nearest first.

    All queries walk in lockstep; each round expands the ``step`` nearest members of a beam not expanded yet.
    """
    q, n = len(queries), len(x)
    rows = np.arange(q)[:, None]
    qn = np.einsum("ij,ij->i", queries, queries)[:, None]
    met = np.zeros((q, n + 1), bool)
    met[:, n] = True  # where NONE points
    ids = np.where(entries < 0, n, entries)
    dist = np.where(ids < n, norms[np.minimum(ids, n - 1)] - 2 * np.einsum("qed,qd->qe", x[np.minimum(ids, n - 1)], queries) + qn, np.inf)
    met[rows, ids] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    same = np.zeros(ids.shape, bool)
    same[:, 1:] = ids[:, 1:] == ids[:, :-1]
    dist[same] = np.inf
    done = ~np.isfinite(dist)
    while True:
        open_ = np.where(done, np.inf, dist)
        k = min(step, open_.shape[1])
        pick = np.argpartition(open_, k - 1, axis=1)[:, :k] if k < open_.shape[1] else np.broadcast_to(np.arange(k), (q, k))
        good = np.isfinite(open_[rows, pick])
        live = good.any(axis=1)
        if not live.any():
            break
        done[rows, pick] = True
        nodes = np.where(good, ids[rows, pick], n)
        near = np.where(nodes[:, :, None] < n, neighbours[np.minimum(nodes, n - 1)], NONE).reshape(q, -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        new = ~met[rows, near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        met[rows, near] = True
        width = int(new.sum(axis=1).max()) if new.any() else 0
        if not width:
            continue
        front = np.argsort(~new, axis=1, kind="stable")[:, :width]
        near, new = near[rows, front], new[rows, front]
        safe = np.minimum(near, n - 1)
        d = np.where(new, norms[safe] - 2 * np.einsum("qed,qd->qe", x[safe], queries) + qn, np.inf)
        ids, dist = np.concatenate([ids, near], axis=1), np.concatenate([dist, d], axis=1)
        done = np.concatenate([done, ~new], axis=1)
        if ids.shape[1] > beam:
            top = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            ids, dist, done = ids[rows, top], dist[rows, top], done[rows, top]
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    return np.where(np.isfinite(dist), ids, NONE), dist


def robust_prune(x, norms, points, candidates, distances, degree: int = DEGREE, alpha: float = ALPHA):
    """For each point the neighbours to keep: nearest first, dropping what a kept one is alpha times closer to (squared distances)."""
    b, c = candidates.shape
    rows = np.arange(b)
    ids = candidates.copy()
    dist = np.where((ids < 0) | (ids == points[:, None]), np.inf, distances)
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows[:, None], order], dist[rows[:, None], order]
    alive = np.isfinite(dist)
    kept = np.full((b, degree), NONE, np.int64)
    safe = np.maximum(ids, 0)
    vectors = x[safe]
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        chosen = safe[rows, first]
        kept[some, k] = chosen[some]
        between = norms[safe] - 2 * np.einsum("bcd,bd->bc", vectors, x[chosen]) + norms[chosen][:, None]
        alive &= (alpha * np.maximum(between, 0) > dist) & (ids != chosen[:, None])
        alive &= some[:, None]
    return kept


def medoid(x) -> int:
    return int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))


def connect(x, norms, adj, points, start: int, degree: int = DEGREE, beam: int = BUILD_BEAM):
    """``adj`` with edges from and to the ``points``: each seeks itself in the graph, and what it meets is pruned to its neighbours, which
    get edges back; lists that grow over their room are pruned again."""
    room = adj.shape[1]

    def prune(points, candidates):
        safe = np.maximum(candidates, 0)
        d = norms[safe] - 2 * np.einsum("bcd,bd->bc", x[safe], x[points]) + norms[points][:, None]
        return robust_prune(x, norms, points, np.where(candidates < 0, NONE, candidates), np.maximum(d, 0), degree)

    count = (adj >= 0).sum(axis=1)
    met, _d = beam_search(x, norms, adj, x[points], np.full((len(points), 1), start), beam)
    kept = prune(points, np.concatenate([met, adj[points]], axis=1))
    adj[points] = NONE
    adj[points, :degree] = kept
    count[points] = (kept >= 0).sum(axis=1)
    src, dst = np.repeat(points, degree), kept.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    starts = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.empty(0, np.int64)
    rank = np.arange(len(dst)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(dst)]])))
    known = (adj[dst] == src[:, None]).any(axis=1)
    src, dst, rank = src[~known], dst[~known], rank[~known]
    place = count[dst] + rank
    fits = place < room
    adj[dst[fits], place[fits]] = src[fits]
    over = np.unique(dst[~fits])
    if len(over):
        # gaps left by known edges are closed, and lists that are full are pruned with what did not fit
        extra = np.full((len(over), int(rank.max()) + 1), NONE, np.int64)
        where = np.searchsorted(over, dst[~fits])
        extra[where, rank[~fits]] = src[~fits]
        kept = prune(over, np.concatenate([adj[over], extra], axis=1))
        adj[over] = NONE
        adj[over, :degree] = kept
    order_adj = np.argsort(adj < 0, axis=1, kind="stable")
    return np.take_along_axis(adj, order_adj, axis=1)


def everyone(n: int, room: int):
    """The adjacency in which each of a few nodes has all others."""
    adj = np.full((n, room), NONE, np.int64)
    for i in range(n):
        adj[i, : n - 1] = np.delete(np.arange(n), i)
    return adj


def build(x, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7, passes: int = 1):
    """Adjacency (n x 2 degree, NONE where short) of the vectors ``x``, built in one pass or more.

    From a random graph, each batch of points is connected by searches of the graph so far from the medoid.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    norms = np.einsum("ij,ij->i", x, x)
    if n <= degree + 1:
        return everyone(n, 2 * degree)
    adj = np.full((n, 2 * degree), NONE, np.int64)
    adj[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    start = medoid(x)
    for _ in range(passes):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            adj = connect(x, norms, adj, order[at:at + BATCH], start, degree, beam)
    return adj


def extend(x, adj, degree: int = DEGREE, beam: int = BUILD_BEAM):
    """The adjacency of all of ``x``, whose first rows ``adj`` connects already: the others are inserted batch by batch."""
    n, old = len(x), len(adj)
    if n <= degree + 1 or old <= degree + 1:
        return build(x, degree, beam)
    norms = np.einsum("ij,ij->i", x, x)
    start = medoid(x[:old])
    adj = np.concatenate([adj, np.full((n - old, adj.shape[1]), NONE, np.int64)])
    for at in range(old, n, BATCH):
        adj = connect(x, norms, adj, np.arange(at, min(n, at + BATCH)), start, degree, beam)
    return adj


def without(x, adj, dead, degree: int = DEGREE):
    """The adjacency without the ``dead`` nodes (boolean), renumbered: who had one as a neighbour gets its neighbours as candidates, pruned."""
    alive = np.flatnonzero(~dead)
    if len(alive) <= degree + 1:
        return everyone(len(alive), adj.shape[1])
    norms = np.einsum("ij,ij->i", x, x)
    gone = np.append(dead, True)  # where NONE points
    for at in range(0, len(alive), BATCH):
        points = alive[at:at + BATCH]
        near = adj[points]
        hurt = ((near >= 0) & gone[near]).any(axis=1)
        if not hurt.any():
            continue
        points, near = points[hurt], near[hurt]
        through = np.where(((near >= 0) & gone[near])[:, :, None], adj[np.maximum(near, 0)], NONE).reshape(len(points), -1)
        both = np.concatenate([near, through], axis=1)
        both = np.where((both >= 0) & ~gone[both], both, NONE)
        # few of the places hold a candidate; they come first, in their order, and the rest is cut off
        none = both < 0
        order = np.argsort(none, axis=1, kind="stable")[:, :max(1, int((~none).sum(axis=1).max()))]
        both = np.take_along_axis(both, order, axis=1)
        safe = np.maximum(both, 0)
        d = norms[safe] - 2 * np.einsum("bcd,bd->bc", x[safe], x[points]) + norms[points][:, None]
        kept = robust_prune(x, norms, points, both, np.maximum(d, 0), degree)
        adj[points] = NONE
        adj[points, :degree] = kept
    number = np.full(len(dead) + 1, NONE, np.int64)
    number[alive] = np.arange(len(alive))
    return number[adj[alive]]
