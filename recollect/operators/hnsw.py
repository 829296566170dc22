"""A hierarchical navigable small-world graph over the vectors of one shard, in flat arrays.

Layer l holds about one node in ``m``^l. Nodes are inserted in batches, upper
layers first: a batch descends from the topmost layer, walks each layer it does
not belong to with a narrow beam and each it joins with ``build`` candidates, and
links to those that pass the diversity rule, and they to it. The members of a
batch also see one another, by one small product, so that nodes that arrive
together can be neighbours. No layer is ever compared with itself as a whole.

All queries of a batch walk at once, the best ``EXPAND`` open candidates of each
per step, so that the work is done on arrays and not per query.
"""

from __future__ import annotations

import numpy as np

M, LINKS, BUILD = 12, 24, 24
#: Beam of the descent; layers of at most SCAN nodes are one, the topmost, which is scanned.
NARROW, SCAN = 4, 64
BATCH = 512
BLOCK = 1024
EXPAND = 3


def levels(n: int, m: int = M) -> np.ndarray:
    """Topmost layer of each of n nodes, geometric with ratio 1/m, the same for equal n."""
    u = np.random.default_rng(n).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(np.int64)


def _best(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, greatest first."""
    k = min(k, sim.shape[1])
    part = np.argpartition(sim, sim.shape[1] - k, axis=1)[:, -k:] if k < sim.shape[1] else np.broadcast_to(np.arange(k), (len(sim), k))
    order = np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class _Layer:
    """Adjacency of one layer: for every node a row of neighbours, nearest first, -1 where there are fewer."""

    def __init__(self, n: int, links: int):
        self.ids = np.full((n, links), -1, dtype=np.int32)
        self.sim = np.full((n, links), -3.0, dtype=np.float32)

    def add(self, src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> None:
        """Add edges; a full row keeps its nearest."""
        rows, at = np.unique(src, return_inverse=True)
        links = self.ids.shape[1]
        r = np.concatenate([np.repeat(np.arange(len(rows)), links), at])
        d = np.concatenate([self.ids[rows].ravel().astype(np.int64), dst])
        s = np.concatenate([self.sim[rows].ravel(), sim])
        keep = d >= 0
        r, d, s = r[keep], d[keep], s[keep]
        _, first = np.unique(r * (len(self.ids) + 1) + d, return_index=True)
        r, d, s = r[first], d[first], s[first]
        order = np.lexsort((d, -s, r))
        r, d, s = r[order], d[order], s[order]
        slot = np.arange(len(r)) - np.searchsorted(r, np.arange(len(rows)))[r]
        ok = slot < links
        ids, sims = np.full((len(rows), links), -1, dtype=np.int32), np.full((len(rows), links), -3.0, dtype=np.float32)
        ids[r[ok], slot[ok]], sims[r[ok], slot[ok]] = d[ok], s[ok]
        self.ids[rows], self.sim[rows] = ids, sims


class Hnsw:
    """Graph over the rows of ``x`` (float32, unit length)."""

    def __init__(self, x: np.ndarray, m: int = M, links: int = LINKS, build: int = BUILD, batch: int = BATCH):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.m, self.n = m, len(x)
        level = levels(self.n, m)
        top = 0
        while (level >= top).sum() > SCAN:
            top += 1
        level = np.minimum(level, top)
        self._seen = np.zeros((BLOCK, self.n + 1), dtype=bool)
        self._mark = np.empty((BLOCK, self.n + 1), dtype=np.int32)
        self.layers = [_Layer(self.n, links) for _ in range(top + 1)]
        order = np.argsort(-level, kind="stable")  # upper nodes first, so that each layer grows from its own entries
        self.top = order[: max(1, int((level == top).sum()))] if self.n else order
        at = 0
        while at < self.n:
            size = min(max(32, min(batch, at)) if at else len(self.top), self.n - at)  # the topmost layer is one batch
            highest = level[order[at]]
            same = int((level[order[at : at + size]] == highest).sum())  # a batch is of one topmost layer
            self._insert(order[at : at + same], int(highest), at, build)
            at += same

    def _insert(self, nodes: np.ndarray, highest: int, built: int, build: int) -> None:
        q = self.x[nodes]
        entry = self._descend(q, highest) if built else None
        own = q @ q.T
        np.fill_diagonal(own, -3.0)
        mates = _best(own, min(build, len(nodes)))
        near = np.take_along_axis(own, mates, 1)
        for layer in range(highest, -1, -1):
            ids, sim = nodes[mates], near
            if built:
                found, s = self._walk(q, layer, entry, build)
                entry = found[:, : min(4, build)]
                ids, sim = np.concatenate([ids, found], axis=1), np.concatenate([sim, s], axis=1)
            cand = _best(sim, 2 * self.m)
            ids, sim = np.take_along_axis(ids, cand, 1), np.take_along_axis(sim, cand, 1)
            r, c = np.nonzero(self._diverse(ids, sim))
            a, b, w = nodes[r], ids[r, c], sim[r, c]
            self.layers[layer].add(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]))

    def _diverse(self, ids: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """Which candidates to link: those nearer to the node than to any kept before, ``m`` at most, and the nearest four."""
        v = self.x[ids]
        between = v @ v.transpose(0, 2, 1)
        valid = sim > -3.0
        kept = np.zeros(ids.shape, dtype=bool)
        count = np.zeros(len(ids), dtype=np.int64)
        for j in range(ids.shape[1]):
            clash = (kept[:, :j] & (between[:, j, :j] > sim[:, j, None])).any(axis=1)
            kept[:, j] = ~clash & (count < self.m)
            count += kept[:, j]
        kept[:, :4] = True
        return kept & valid

    def _descend(self, q: np.ndarray, below: int) -> np.ndarray:
        """Entries for layer ``below``: the topmost layer's few nodes are scanned, those between are walked."""
        entry = self.top[_best(q @ self.x[self.top].T, 4)]
        for layer in range(len(self.layers) - 1, below, -1):
            entry = self._walk(q, layer, entry, NARROW)[0]
        return entry

    def search(self, q: np.ndarray, k: int, ef: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k nearest found for each query, best first; -1 where fewer.

        ``own`` gives the queries' own rows where they are members: they start there.
        """
        ef = max(ef, k)
        if not len(q) or not self.n:
            return np.full((len(q), k), -1, dtype=np.int64), np.full((len(q), k), -3.0, dtype=np.float32)
        rows, sims = [], []
        for at in range(0, len(q), BLOCK):
            part = q[at : at + BLOCK]
            entry = self._descend(part, 0) if own is None else own[at : at + BLOCK, None].astype(np.int64)
            r, s = self._walk(part, 0, entry, ef)
            rows.append(r[:, :k])
            sims.append(s[:, :k])
        return np.concatenate(rows), np.concatenate(sims)

    def _walk(self, q: np.ndarray, layer: int, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first beam of width ``ef`` from ``entry`` for all queries at once: (rows, similarities), best first."""
        x, links = self.x, self.layers[layer].ids
        b, n = len(q), self.n
        ids = np.full((b, ef), -1, dtype=np.int64)
        sim = np.full((b, ef), -3.0, dtype=np.float32)
        done = np.ones((b, ef), dtype=bool)
        e = min(entry.shape[1], ef)
        ids[:, :e] = entry[:, :e]
        sim[:, :e] = np.where(ids[:, :e] >= 0, np.matmul(x[ids[:, :e]], q[:, :, None])[:, :, 0], -3.0)
        done[:, :e] = ids[:, :e] < 0
        seen, mark = self._seen[:b], self._mark[:b]
        seen[:] = False
        seen[:, n] = True  # row -1, no neighbour: the place before a query's first
        seen[np.arange(b)[:, None], ids[:, :e]] = True
        seen, mark, row = seen.reshape(-1), mark.reshape(-1), np.arange(b) * (n + 1)
        live = np.arange(b)
        width = min(EXPAND, ef)
        while len(live):
            beam = sim[live]
            s = np.where(done[live], -9.0, beam)
            best = np.argpartition(s, ef - width, axis=1)[:, ef - width :] if width < ef else np.broadcast_to(np.arange(ef), s.shape)
            score = np.take_along_axis(s, best, 1)
            go = (score > -9.0).any(axis=1)
            if not go.all():
                live, best, score, beam = live[go], best[go], score[go], beam[go]
                if not len(live):
                    break
            done[live[:, None], best] = True
            nb = links[ids[live[:, None], best]]
            nb[score <= -9.0] = -1
            nb = nb.reshape(len(live), -1)
            at = (row[live, None] + nb).reshape(-1)
            new = np.nonzero(~seen.take(at))[0]
            r, at = new // nb.shape[1], at[new]
            mark[at] = turn = np.arange(len(r), dtype=np.int32)
            once = mark.take(at) == turn  # the same neighbour of two expanded nodes counts once
            r, at = r[once], at[once]
            seen[at] = True
            asking = live[r]
            to = at - row[asking]
            value = np.einsum("nd,nd->n", x.take(to, axis=0), q.take(asking, axis=0))
            better = value > beam.min(axis=1)[r]
            r, to, value = r[better], to[better], value[better]
            if not len(r):
                continue
            count = np.bincount(r, minlength=len(live))
            moved = np.nonzero(count)[0]  # the beams of the others stay
            beam, moved, count = beam[moved], live[moved], count[moved]
            place = np.repeat(np.arange(len(moved)), count)
            slot = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            room = int(count.max())
            more_s = np.full((len(moved), room), -3.0, dtype=np.float32)
            more_i = np.full((len(moved), room), -1, dtype=np.int64)
            more_s[place, slot], more_i[place, slot] = value, to
            all_s = np.concatenate([beam, more_s], axis=1)
            pick = np.argpartition(all_s, room, axis=1)[:, room:] + np.arange(len(moved))[:, None] * (ef + room)
            sim[moved] = all_s.take(pick)
            ids[moved] = np.concatenate([ids[moved], more_i], axis=1).take(pick)
            done[moved] = np.concatenate([done[moved], more_i < 0], axis=1).take(pick)
        order = np.argsort(-sim, axis=1, kind="stable")
        sim = np.take_along_axis(sim, order, 1)
        return np.where(sim > -3.0, np.take_along_axis(ids, order, 1), -1), sim
