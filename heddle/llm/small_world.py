"""A navigable small-world graph over 128-bit codes and Hamming distance, searched for many queries at once in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64


def distances(codes: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hamming distances of each row's query code to the codes at its places."""
    d = np.bitwise_count(codes[at, 0] ^ q[:, None, 0])
    d += np.bitwise_count(codes[at, 1] ^ q[:, None, 1])
    return d


class SmallWorld:
    """Nodes are inserted in batches that double the graph; each is linked to its nearest nodes found by a beam search, and they to it.

    Early nodes' links reach far, late ones' near. Links back are kept as long as a node has room for them.
    """

    def __init__(self, codes: np.ndarray, links: int = 12, room: int = 48, beam: int = 32, seed: int = 5) -> None:
        self.codes, n = codes, len(codes)
        self.order = np.random.default_rng(seed).permutation(n)
        self.adjacent = np.full((n, room), -1, np.int32)
        self.degree = np.zeros(n, np.int64)
        done = min(n, 2 * links)
        first = self.order[:done]
        for v in first:
            self._link(np.full(done - 1, v), first[first != v], room)
        while done < n:
            batch = self.order[done : 2 * done]
            near, d = self.search(codes[batch], beam, np.broadcast_to(self.order[: min(8, done)], (len(batch), min(8, done))))
            near, d = near[:, :links], d[:, :links]
            v, k = np.nonzero(near >= 0)
            self._link(batch[v], near[v, k], room)
            self._link(near[v, k], batch[v], room)
            done += len(batch)

    def _link(self, a: np.ndarray, b: np.ndarray, room: int) -> None:
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        slot = self.degree[a] + np.arange(len(a)) - np.searchsorted(a, a)
        fits = slot < room
        self.adjacent[a[fits], slot[fits]] = b[fits]
        np.add.at(self.degree, a[fits], 1)

    def search(self, q: np.ndarray, beam: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of each query's beam, nearest first; -1 and 255 where the beam isn't full. entries: start nodes."""
        n, rows = len(q), np.arange(len(q))
        seen = np.zeros((n, len(self.codes) + 1), bool)  # the last column stands for no node
        at = np.full((n, beam), -1, np.int64)
        dist = np.full((n, beam), 255, np.uint8)
        open_ = np.zeros((n, beam), bool)
        new = np.array(entries, np.int64)
        active = rows
        while len(active):
            fresh = (new >= 0) & ~seen[active[:, None], new]
            seen[active[:, None], np.where(new >= 0, new, -1)] = True
            d = distances(self.codes, q[active], np.maximum(new, 0))
            d[~fresh] = 255
            all_at = np.concatenate([at[active], np.where(fresh, new, -1)], axis=1)
            all_d = np.concatenate([dist[active], d], axis=1)
            all_open = np.concatenate([open_[active], fresh], axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            at[active], dist[active], open_[active] = (np.take_along_axis(x, keep, axis=1) for x in (all_at, all_d, all_open))
            active = active[open_[active].any(axis=1)]
            if not len(active):
                break
            k = open_[active].argmax(axis=1)  # beams are sorted: the nearest that wasn't followed
            open_[active, k] = False
            new = self.adjacent[at[active, k]].astype(np.int64)
        return at, dist
