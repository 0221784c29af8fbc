"""Robust-pruned graphs over the vectors of one shard, and beam search in them, for many queries at a time."""

from __future__ import annotations

import numpy as np

QUERIES_AT_ONCE = 256


def prune(points: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each point from its row of candidates (-1: none).

    The nearest candidate is kept; it rules out every other that is ``alpha`` times nearer to it than
    to the point; and so on.
    """
    out = np.full((len(points), degree), -1, np.int32)
    for a in range(0, len(points), QUERIES_AT_ONCE):
        p, c = points[a : a + QUERIES_AT_ONCE], candidates[a : a + QUERIES_AT_ONCE]
        order = np.argsort(c, axis=1)
        c = np.take_along_axis(c, order, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1  # repeated candidates
        c[c == p[:, None]] = -1
        near = vectors[c]
        far = ((near - vectors[p][:, None]) ** 2).sum(axis=2)
        far[c < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")[:, : 4 * degree]
        c, far = np.take_along_axis(c, order, axis=1), np.take_along_axis(far, order, axis=1)
        near = np.take_along_axis(near, order[:, :, None], axis=1)
        norm = (near**2).sum(axis=2)
        between = norm[:, :, None] + norm[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
        alive, row = np.isfinite(far), np.arange(len(p))
        for k in range(degree):
            first = alive.argmax(axis=1)
            there = alive[row, first]
            if not there.any():
                break
            out[a + row[there], k] = c[row, first][there]
            alive &= alpha * between[row, first] > far
            alive[row, first] = False
    return out


def search(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, step: int = 4, reach: float | None = None):
    """Best-first search by inner product from the entry points, for a block of queries.

    Returns beam ids and products, best first.  With ``reach``, every node of at least that product
    is expanded as well, however many there are, and the (query, node) pairs seen are returned instead.
    """
    n, width = len(queries), graph.shape[1]
    seen = np.zeros((n, len(vectors)), bool)
    row = np.arange(n)[:, None]
    ids = np.broadcast_to(entries, (n, len(entries))).astype(np.int64)
    seen[row, ids] = True
    value = queries @ vectors[entries].T
    done = np.zeros(ids.shape, bool)
    pairs = []

    def grow(ids, value, done):
        if reach is not None:
            found = np.nonzero(value >= reach)
            pairs.append((found[0], ids[found]))
        size = ids.shape[1]
        if size <= beam:
            return ids, value, done
        # with a reach, whatever lies within it must stay until expanded
        rank = value if reach is None else np.where((value >= reach) & ~done, value + 4.0, value)
        order = np.argpartition(-rank, beam - 1, axis=1)[:, :beam]
        if reach is not None and size > beam:
            left = ((value >= reach) & ~done).sum(axis=1).max()
            if left > beam:
                order = np.argsort(-rank, axis=1)[:, :left]
        return (np.take_along_axis(x, order, axis=1) for x in (ids, value, done))

    ids, value, done = grow(ids, value, done)
    while True:
        rank = np.where(done | ~np.isfinite(value), -np.inf, value)
        take = min(step, rank.shape[1])
        pick = np.argpartition(-rank, take - 1, axis=1)[:, :take]
        good = np.take_along_axis(rank, pick, axis=1) > -np.inf
        active = np.flatnonzero(good.any(axis=1))
        if not len(active):
            break
        np.put_along_axis(done, pick, True, axis=1)
        nodes = np.take_along_axis(ids, pick, axis=1)
        near = np.where(good[:, :, None], graph[nodes], -1).reshape(n, take * width)[active].astype(np.int64)
        fresh = (near >= 0) & ~seen[active[:, None], near]
        # one node may be met from two of the picked ones
        order = np.argsort(near, axis=1, kind="stable")
        near, fresh = np.take_along_axis(near, order, axis=1), np.take_along_axis(fresh, order, axis=1)
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        most = int(fresh.sum(axis=1).max())
        if not most:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        near, fresh = np.take_along_axis(near, order, axis=1), np.take_along_axis(fresh, order, axis=1)
        at = np.nonzero(fresh)
        seen[active[at[0]], near[at]] = True
        got = np.full((n, most), -np.inf, np.float32)
        got[active] = np.where(fresh, np.matmul(vectors[near], queries[active][:, :, None])[:, :, 0], -np.inf)
        new = np.full((n, most), 0, np.int64)
        new[active] = near
        ids, value, done = grow(np.concatenate([ids, new], 1), np.concatenate([value, got], 1), np.concatenate([done, ~np.isfinite(got)], 1))
    if reach is not None:
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(value, order, axis=1)


def medoid(vectors: np.ndarray) -> int:
    return int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())


class SearchGraph:
    """Directed graph for inner-product search over one shard's vectors.

    A further coordinate brings all vectors to one length, so that near in the graph is large in
    product.  Points enter in batches: a beam search from the medoid proposes neighbours, pruning
    keeps diverse ones, and the kept ones are linked back.  A second pass relaxes the pruning.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 32, beam: int = 48, alphas: tuple[float, ...] = (1.0, 1.44)):
        norm = (vectors**2).sum(axis=1)
        self.vectors = np.concatenate([vectors, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], axis=1).astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(5)
        self.graph = rng.integers(0, max(n, 1), (n, degree)).astype(np.int32)
        self.start = np.array([medoid(self.vectors)]) if n else np.empty(0, int)
        for alpha in alphas:
            order = rng.permutation(n)
            for a in range(0, n, QUERIES_AT_ONCE):
                self._enter(order[a : a + QUERIES_AT_ONCE], beam, degree, alpha)

    def _enter(self, points: np.ndarray, beam: int, degree: int, alpha: float) -> None:
        found, value = search(self.vectors, self.graph, self.vectors[points], self.start, beam)
        found = np.where(np.isfinite(value), found, -1).astype(np.int32)
        kept = prune(points, np.concatenate([found, self.graph[points]], axis=1), self.vectors, degree, alpha)
        self.graph[points] = kept
        at, column = np.nonzero(kept >= 0)
        target, source = kept[at, column], points[at].astype(np.int32)
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), min(int(count.max(initial=0)), 2 * degree)), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(first, count)
        inside = place < extra.shape[1]
        extra[np.repeat(np.arange(len(nodes)), count)[inside], place[inside]] = source[inside]
        self.graph[nodes] = prune(nodes, np.concatenate([self.graph[nodes], extra], axis=1), self.vectors, degree, alpha)

    def nearest(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Node numbers for each query, best first, -1 where there are fewer."""
        wide = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        out = np.full((len(queries), min(beam, len(self.vectors))), -1)
        for a in range(0, len(queries), QUERIES_AT_ONCE):
            ids, value = search(self.vectors, self.graph, wide[a : a + QUERIES_AT_ONCE], self.start, beam)
            ids = np.where(np.isfinite(value), ids, -1)[:, : out.shape[1]]
            out[a : a + QUERIES_AT_ONCE, : ids.shape[1]] = ids
        return out
