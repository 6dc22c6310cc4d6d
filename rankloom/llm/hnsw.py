"""Hierarchical navigable small-world graphs over unit vectors, built and searched in batches of array operations.

Nodes are ordered by level, so a level's nodes are a prefix of those below.  A search starts from the best nodes of the
smallest level, and runs a beam on each level down to the lowest.  All queries of a batch take their steps together.
"""

from __future__ import annotations

import io

import numpy as np

DEGREE, LOWEST = 16, 32
BUILD_BEAM = 64
TOP = 1024
STEP = 4


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Per row at most ``most`` of the candidates (-1: none): first those nearer to the node than to any chosen before, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    valid = ids >= 0
    vectors = x[np.maximum(ids, 0)]
    pair = vectors @ vectors.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    nearest = np.full(ids.shape, -2.0, np.float32)
    for i in range(ids.shape[1]):
        take = valid[:, i] & (nearest[:, i] < sims[:, i])
        chosen[:, i] = take
        np.maximum(nearest, np.where(take[:, None], pair[:, :, i], -2.0), out=nearest)
    rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((len(ids), most), -1, np.int32)
    out[:, : rank.shape[1]] = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
    return out


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of a beam of ``width`` for each query over the nodes with links; -1 and -2 where there are fewer."""
    n, b = len(links), len(q)
    ids, sims = np.full((b, width), -1, np.int32), np.full((b, width), -2.0, np.float32)
    done = np.zeros((b, width), bool)
    seen = np.zeros((b, n), np.int32)
    e = min(width, entries.shape[1])
    entries = entries[:, :e]
    rows = np.repeat(np.arange(b), e)
    ids[:, :e] = entries
    sims[:, :e] = np.einsum("bed,bd->be", x[np.maximum(entries, 0)], q)
    sims[ids < 0] = -2.0
    known = entries.ravel() >= 0
    seen[rows[known], entries.ravel()[known]] = -1
    live = np.arange(b)
    while len(live):
        open_sims = np.where(done[live] | (ids[live] < 0), -3.0, sims[live])
        k = min(STEP, width)
        pick = np.argpartition(-open_sims, k - 1, axis=1)[:, :k] if width > k else np.broadcast_to(np.arange(width), open_sims.shape)
        good = np.take_along_axis(open_sims, pick, 1) > -2.5
        some = good.any(1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        done[live[:, None], pick] |= good
        near = links[np.where(good, ids[live[:, None], pick], 0)]
        near = np.where(good[:, :, None], near, -1).reshape(len(live), -1)
        r, c = np.nonzero(near >= 0)
        node = near[r, c]
        fresh = seen[live[r], node] == 0
        r, c, node = r[fresh], c[fresh], node[fresh]
        stamp = np.arange(1, len(r) + 1, dtype=np.int32)
        seen[live[r], node] = stamp
        first = seen[live[r], node] == stamp  # one of those met twice in this step
        r, c, node = r[first], c[first], node[first]
        new = np.full(near.shape, -2.0, np.float32)
        for a in range(0, len(r), 1 << 17):
            s = slice(a, a + (1 << 17))
            new[r[s], c[s]] = np.einsum("kd,kd->k", x[node[s]], q[live[r[s]]])
        all_sims = np.concatenate([sims[live], new], 1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        all_ids = np.concatenate([ids[live], np.where(new > -2.0, near, -1)], 1)
        all_done = np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
        sims[live], ids[live], done[live] = (np.take_along_axis(v, best, 1) for v in (all_sims, all_ids, all_done))
    return ids, sims


class Graph:
    """x: unit vectors (float32) ordered by level; levels: links of each level's prefix, from the top down."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]):
        self.x, self.levels = x, levels

    @staticmethod
    def order(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(order of nodes, sizes of the levels from the top): levels by a geometric draw from 64-bit hashes."""
        u = (keys >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(DEGREE)).astype(np.int64)
        order = np.lexsort((keys, -level))
        sizes = [int((level >= i).sum()) for i in range(int(level.max()) + 1)][::-1] if len(keys) else []
        return order, [s for i, s in enumerate(sizes) if s > TOP or i + 1 == len(sizes) or sizes[i + 1] > TOP]

    @classmethod
    def build(cls, x: np.ndarray, sizes: list[int]) -> Graph:
        g = cls(x, [])
        for size in sizes:
            most = LOWEST if size == sizes[-1] else DEGREE
            links = np.full((size, most), -1, np.int32)
            n = min(size, TOP)
            sims = x[:n] @ x[:n].T
            np.fill_diagonal(sims, -2.0)
            for a in range(0, n, 256):
                g._link(links, np.arange(a, min(n, a + 256)), *cls._top(sims[a : a + 256], BUILD_BEAM))
            while n < size:
                b = min(size, n + min(n, 2048))
                for a in range(n, b, 256):
                    new = np.arange(a, min(b, a + 256))
                    ids, found = _beam(x, links, x[new], g._entries(x[new], n), BUILD_BEAM)
                    own = x[new] @ x[n:b].T
                    own[np.arange(len(new)), new - n] = -2.0
                    more, more_sims = cls._top(own, BUILD_BEAM // 2)
                    g._link(links, new, np.concatenate([ids, np.where(more >= 0, more + n, -1)], 1), np.concatenate([found, more_sims], 1))
                n = b
            g.levels.append(links)
        return g

    @staticmethod
    def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        k = min(k, sims.shape[1])
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        found = np.take_along_axis(sims, at, 1)
        return np.where(found > -1.5, at, -1).astype(np.int32), found

    def _link(self, links: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        most = links.shape[1]
        out = _select(self.x, ids, np.where(ids >= 0, sims, -2.0).astype(np.float32), most // 2)
        links[new, : most // 2] = np.where(links[new, : most // 2] >= 0, links[new, : most // 2], out)
        r, c = np.nonzero(out >= 0)
        source, target = new[r], out[r, c]
        sim = np.einsum("kd,kd->k", self.x[source], self.x[target])
        by = np.lexsort((-sim, target))
        source, target, sim = source[by], target[by], sim[by]
        nodes, start = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(start, np.diff(np.append(start, len(target))))
        keep = place < most // 2
        row = np.searchsorted(nodes, target[keep])
        extra = np.full((len(nodes), most // 2), -1, np.int32)
        extra[row, place[keep]] = source[keep]
        for a in range(0, len(nodes), 512):
            at = nodes[a : a + 512]
            cand = np.concatenate([links[at], extra[a : a + 512]], 1)
            order = np.sort(cand, axis=1)  # a link met twice counts once
            cand = np.where(np.concatenate([np.ones((len(order), 1), bool), order[:, 1:] != order[:, :-1]], 1), order, -1)
            cand = np.where(cand == at[:, None], -1, cand)
            s = np.einsum("ucd,ud->uc", self.x[np.maximum(cand, 0)], self.x[at])
            links[at] = _select(self.x, cand, np.where(cand >= 0, s, -2.0).astype(np.float32), most)

    def _entries(self, q: np.ndarray, upto: int) -> np.ndarray:
        """Nodes from which to search: the best of the first ones, then beams on the levels that are done."""
        n = min(TOP, upto, len(self.levels[0]) if self.levels else upto)
        found = self._top(q @ self.x[:n].T, 4)[0]
        for links in self.levels:
            found = _beam(self.x, links, q, found, 16)[0]
        return found

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the lowest level's beam for each query."""
        n = len(self.x)
        batch = max(16, min(512, (1 << 24) // max(n, 1)))
        ids, sims = [], []
        for a in range(0, len(q), batch):
            part = q[a : a + batch]
            entries = self._top(part @ self.x[: min(TOP, len(self.levels[0]))].T, 4)[0]
            for links in self.levels[:-1]:
                entries = _beam(self.x, links, part, entries, 16)[0]
            i, s = _beam(self.x, self.levels[-1], part, entries, min(width, n))
            ids.append(i)
            sims.append(s)
        return (np.concatenate(ids), np.concatenate(sims)) if ids else (np.zeros((0, width), np.int32), np.zeros((0, width), np.float32))

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, n_levels=len(self.levels), **{f"level{i}": x for i, x in enumerate(self.levels)}, **more)
        return out.getvalue()
