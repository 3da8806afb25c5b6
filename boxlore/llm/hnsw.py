"""A hierarchical navigable small-world graph over the unit vectors of one shard.

Vectors enter in batches, by levels drawn from a geometric law: each finds its nearest
neighbours by beam search in the graph so far, links to the closest that aren't closer to
one another than to it, and is linked back.  Searches of many vectors run side by side.
"""

from __future__ import annotations

import numpy as np


class Graph:
    """``leaders`` are the vectors in the graph; ``follows`` gives each vector's leader (a position in leaders).

    A vector within ``near`` (a cosine) of a leader follows it and stays out of the graph,
    so a crowd of copies takes one node and beams aren't filled by copies.
    """

    def __init__(self, vectors: np.ndarray, near: float, neighbours: int = 12, beam: int = 40, seed: int = 7):
        given = vectors.astype(np.float32)
        n = len(given)
        self.follows = np.full(n, -1, np.int64)
        self.leaders = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, given.shape[1]), np.float32)
        drawn = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(neighbours)).astype(int)
        drawn[:1] = drawn.max(initial=0)  # the first is the entry point of every search
        self.top = int(drawn.max(initial=0))
        self.links = [np.zeros((0, 2 * neighbours if level == 0 else neighbours), np.int32) for level in range(self.top + 1)]
        at = 0
        while at < n:
            new = np.arange(at, min(n, at + min(1024, max(1, at // 2))))
            at += len(new)
            if len(self.leaders):
                found, close = self.search(given[new], beam // 2)
                joined = close[:, 0] >= near
                self.follows[new[joined]] = found[joined, 0]
                new = new[~joined]
            new = self._lead(given, new, near)
            if len(new):
                first = len(self.leaders)
                self.leaders = np.concatenate([self.leaders, new])
                self.vectors = np.concatenate([self.vectors, given[new]])
                self.links = [np.concatenate([x, np.full((len(new), x.shape[1]), -1, np.int32)]) for x in self.links]
                if first == 0 and len(new) == 1:
                    continue
                self._enter(np.arange(first, first + len(new)), drawn[new], beam, neighbours)

    def _lead(self, given: np.ndarray, new: np.ndarray, near: float) -> np.ndarray:
        """Leaders among new vectors that have none; the others follow the first near leader."""
        between = given[new] @ given[new].T
        free, out = np.ones(len(new), bool), []
        for k in range(len(new)):
            if free[k]:
                crowd = free & (between[k] >= near)
                crowd[k] = True
                self.follows[new[crowd]] = len(self.leaders) + len(out)
                free &= ~crowd
                out.append(k)
        return new[out]

    def _enter(self, new: np.ndarray, levels: np.ndarray, beam: int, neighbours: int) -> None:
        entry = np.zeros(len(new), np.int64)
        for level in range(self.top, -1, -1):
            found, near = self.search_level(self.vectors[new], entry, level, beam if level == 0 or (levels >= level).any() else 1)
            entry = found[:, 0]
            for k in np.flatnonzero(levels >= level):
                others = found[k] != new[k]
                chosen = self._spread(found[k][others], near[k][others], neighbours)
                self.links[level][new[k], : len(chosen)] = chosen
                for other in chosen:
                    self._link_back(level, other, new[k])

    def _spread(self, found: np.ndarray, near: np.ndarray, most: int) -> list[int]:
        """The nearest that are closer to the new vector than to one chosen before; then the nearest others."""
        ids = found[found >= 0]
        between = self.vectors[ids] @ self.vectors[ids].T
        chosen: list[int] = []
        for k in range(len(ids)):
            if len(chosen) == most:
                break
            if not chosen or between[k, chosen].max() < near[k]:
                chosen.append(k)
        rest = [k for k in range(len(ids)) if k not in chosen]
        return ids[chosen + rest[: most - len(chosen)]].tolist()

    def _link_back(self, level: int, node: int, new: int) -> None:
        row = self.links[level][node]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        ids = np.append(row, new)
        near = self.vectors[ids] @ self.vectors[node]
        order = np.argsort(-near, kind="stable")
        kept = self._spread(ids[order], near[order], len(row))
        row[:] = -1
        row[: len(kept)] = kept

    def search_level(self, queries: np.ndarray, entry: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beams (nodes, similarities), best first, of searches that start at ``entry``."""
        q, links = len(queries), self.links[level]
        nodes = np.full((q, beam), -1, np.int64)
        near = np.full((q, beam), -2.0, np.float32)
        done = np.ones((q, beam), bool)
        nodes[:, 0] = entry
        near[:, 0] = np.einsum("ij,ij->i", queries, self.vectors[entry])
        done[:, 0] = False
        seen = np.zeros((q, len(self.vectors)), bool)
        seen[np.arange(q), entry] = True
        active = np.arange(q)
        while len(active):
            best = np.where(done[active], -3.0, near[active]).argmax(axis=1)
            open_ = ~done[active, best]
            active, best = active[open_], best[open_]
            if not len(active):
                break
            done[active, best] = True
            around = links[nodes[active, best]].astype(np.int64)
            fresh = (around >= 0) & ~seen[active[:, None], around]
            rows, columns = np.nonzero(fresh)
            if not len(rows):
                continue
            ids = around[rows, columns]
            seen[active[rows], ids] = True
            got = np.full(around.shape, -2.0, np.float32)
            got[rows, columns] = np.einsum("ij,ij->i", self.vectors[ids], queries[active[rows]])
            all_near = np.concatenate([near[active], got], axis=1)
            all_nodes = np.concatenate([nodes[active], np.where(fresh, around, -1)], axis=1)
            all_done = np.concatenate([done[active], ~fresh], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            near[active] = np.take_along_axis(all_near, order, 1)
            nodes[active] = np.take_along_axis(all_nodes, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1)
        return nodes, near

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        queries = queries.astype(np.float32)
        entry = np.zeros(len(queries), np.int64)
        for level in range(self.top, 0, -1):
            entry = self.search_level(queries, entry, level, 4)[0][:, 0]
        return self.search_level(queries, entry, 0, min(beam, len(self.vectors)))
