"""A hierarchical navigable small-world graph over one shard of unit vectors, in flat neighbour arrays.

Every vector has a top level drawn from its id with geometrically falling odds; the graph of a level holds the vectors
that reach it. Levels are made from the top down. The vectors of the level above are there from the start with their
links; the others are inserted in batches of at most ``GROWTH`` of what is there: each batch searches the graph as it
stands, from where a descent through the levels above arrives, and its own vectors among each other; of what it finds a
vector takes ``links`` neighbours, diverse ones first, and they take it among their at most ``2 * links``. A level is one
array of ``(vectors, 2 * links)`` ids, filled up with -1.

A search descends from the small top level greedily and ends in a beam of ``ef`` on the ground level; many queries move
in lockstep, so each hop is a few array operations for all of them.
"""

from __future__ import annotations

import numpy as np

#: Vectors of a level small enough to be compared with directly.
TOP = 24
#: Queries that move together.
ROWS = 1024
#: Share of a level's vectors that is inserted at once, and the beam of an insertion.
GROWTH, BUILD = 0.25, 48


def unit_hash(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) from each id."""
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def _diverse(x: np.ndarray, node: np.ndarray, ids: np.ndarray, sims: np.ndarray, take: int) -> np.ndarray:
    """At most ``take`` of each node's candidates (-1 for none), nearest first: those that are nearer to the node than to
    any chosen before them, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = x[ids]
    among = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros(ids.shape, bool)
    for t in range(ids.shape[1]):
        rival = np.where(kept[:, :t], among[:, t, :t], -np.inf).max(axis=1) if t else np.full(len(ids), -np.inf)
        kept[:, t] = (sims[:, t] > rival) & (ids[:, t] >= 0)
    order = np.argsort(np.where(ids >= 0, (~kept).astype(np.int8), 2), axis=1, kind="stable")[:, :take]
    return np.take_along_axis(ids, order, 1)


def _unique(ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repeats; what falls out becomes -1."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1).copy(), np.take_along_axis(sims, order, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids, np.where(ids >= 0, sims, -np.inf)


class Graph:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, links: int = 12):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.n = n = len(self.x)
        level = np.floor(-np.log(unit_hash(ids, 1)) / np.log(links)).astype(int)
        top = int(level.max()) if n else 0
        # The top level is the highest with more than a few vectors, or the ground.
        while top and (level >= top).sum() <= TOP // 2:
            top -= 1
        #: Per level, the ground first: positions of its vectors in order, and their neighbours in the level's numbering.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros((0, 2 * links), np.int32))] * (top + 1)
        turn = np.argsort(unit_hash(ids, 2), kind="stable")
        above = np.zeros(0, np.int64)
        for depth in range(top, -1, -1):
            at = np.flatnonzero(level >= depth)
            links_of = np.full((len(at), 2 * links), -1, np.int32)
            if len(above):
                old_at, old = self.levels[depth + 1]
                place = np.searchsorted(at, old_at)
                links_of[place] = np.where(old >= 0, place[np.maximum(old, 0)], -1)
            self.levels[depth] = (at, links_of)
            rest = turn[level[turn] >= depth]
            rest = np.searchsorted(at, rest[~np.isin(rest, above)])
            there, done = len(above), 0
            while done < len(rest):
                batch = rest[done : done + (max(TOP, int(there * GROWTH)) if there else 2 * TOP)]
                self._insert(depth, batch, there, links)
                there, done = there + len(batch), done + len(batch)
            above = at

    def _insert(self, depth: int, batch: np.ndarray, there: int, links: int) -> None:
        """Links new vectors, given in the level's numbering, to the graph as it stands and to each other."""
        at, table = self.levels[depth]
        x, width = self.x[at], links + links // 2
        q = x[batch]
        s = q @ q.T
        np.fill_diagonal(s, -np.inf)
        k = min(width, len(batch) - 1)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(batch), 0), int)
        ids, sims = batch[best].astype(np.int32), np.take_along_axis(s, best, 1)
        if there:
            found, near = [], []
            for a in range(0, len(q), ROWS):
                # The first few vectors of a top level have no level above them: the search starts from one of them.
                entry = self._descend(q[a : a + ROWS], depth) if depth < len(self.levels) - 1 else np.full((len(q[a : a + ROWS]), 1), at[self.first])
                f, n = self._beam(q[a : a + ROWS], entry, depth, max(BUILD, width))
                found.append(np.where(f >= 0, np.searchsorted(at, f), -1).astype(np.int32))
                near.append(n)
            ids, sims = np.concatenate([ids, np.concatenate(found)], 1), np.concatenate([sims, np.concatenate(near)], 1)
        else:
            self.first = int(batch[0])
        if not ids.shape[1]:
            return
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        own = _diverse(x, batch, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), links)
        table[batch, : own.shape[1]] = own
        # The other sides, each with the strongest of those that chose it.
        src, dst = np.repeat(batch, own.shape[1]), own.ravel()
        src, dst = src[dst >= 0].astype(np.int32), dst[dst >= 0]
        sim = np.einsum("nd,nd->n", x[src], x[dst])
        order = np.lexsort((-sim, dst))
        src, dst, sim = src[order], dst[order], sim[order]
        rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
        fits = rank < 2 * links
        touched, row = np.unique(dst[fits], return_inverse=True)
        more = np.full((len(touched), int(rank[fits].max()) + 1 if fits.any() else 0), -1, np.int32)
        more_s = np.full(more.shape, -np.inf, np.float32)
        more[row, rank[fits]], more_s[row, rank[fits]] = src[fits], sim[fits]
        held = table[touched]
        held_s = np.where(held >= 0, np.einsum("nkd,nd->nk", x[held], x[touched]), -np.inf)
        ids, sims = _unique(np.concatenate([held, more], 1), np.concatenate([held_s, more_s], 1))
        full = (ids >= 0).sum(axis=1) > 2 * links
        out = np.sort(ids, axis=1)[:, ::-1][:, : 2 * links].copy()
        if full.any():
            out[full] = _diverse(x, touched[full], ids[full], sims[full], 2 * links)
        table[touched] = -1
        table[touched, : out.shape[1]] = out

    def _descend(self, q: np.ndarray, depth: int) -> np.ndarray:
        """Where a search arrives on a level, from the top: positions, at most three a query."""
        at, _ = self.levels[-1]
        s = q @ self.x[at].T
        entry = at[np.argsort(-s, axis=1, kind="stable")[:, : min(len(at), 2)]]
        for d in range(len(self.levels) - 2, depth, -1):
            entry = self._beam(q, entry, d, 4)[0][:, :3]
        return entry

    def search(self, queries: np.ndarray, k: int, ef: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the k most similar vectors of each query, best first; -1 where there are none."""
        out_at = np.full((len(queries), k), -1, np.int32)
        out_s = np.full((len(queries), k), -np.inf, np.float32)
        for a in range(0, len(queries), rows):
            at, s = self._search(np.ascontiguousarray(queries[a : a + rows], np.float32), max(ef, k))
            m = min(k, at.shape[1])
            out_at[a : a + rows, :m], out_s[a : a + rows, :m] = at[:, :m], s[:, :m]
        return out_at, out_s

    def _search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.levels) == 1:
            entry = np.broadcast_to(np.arange(min(2, self.n)), (len(q), min(2, self.n)))
        else:
            entry = self._descend(q, 0)
        return self._beam(q, entry, 0, ef)

    def _beam(self, q: np.ndarray, entry: np.ndarray, depth: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        at, links = self.levels[depth]
        x = self.x[at] if depth else self.x
        b, n = len(q), len(at)
        row = np.arange(b)
        start = np.where(entry >= 0, np.searchsorted(at, entry), -1)
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), -np.inf, np.float32)
        fresh = np.zeros((b, ef), bool)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        m = min(start.shape[1], ef)
        ids[:, :m] = start[:, :m]
        sims[:, :m] = np.where(start[:, :m] >= 0, np.einsum("bmd,bd->bm", x[start[:, :m]], q), -np.inf)
        fresh[:, :m] = start[:, :m] >= 0
        seen[row[:, None], np.where(start[:, :m] >= 0, start[:, :m], n)] = True
        active = row
        while len(active):
            f = np.where(fresh[active], sims[active], -np.inf)
            pick = f.argmax(axis=1)
            going = f[np.arange(len(active)), pick] > -np.inf
            active, pick = active[going], pick[going]
            if not len(active):
                break
            fresh[active, pick] = False
            near = links[ids[active, pick]]
            near = np.where(near >= 0, near, n)
            new = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            which, column = np.nonzero(new)
            node = near[which, column]
            value = np.einsum("nd,nd->n", x[node], q[active[which]])
            # Only what beats the beam's last place enters it.
            use = value > sims[active[which], -1]
            if not use.any():
                continue
            which, node, value = which[use], node[use], value[use]
            touched, local = np.unique(which, return_inverse=True)
            place = np.arange(len(which)) - np.searchsorted(which, which)
            width = int(place.max()) + 1
            add_i, add_s = np.full((len(touched), width), -1, np.int32), np.full((len(touched), width), -np.inf, np.float32)
            add_i[local, place], add_s[local, place] = node, value
            r = active[touched]
            all_i, all_s = np.concatenate([ids[r], add_i], 1), np.concatenate([sims[r], add_s], 1)
            all_f = np.concatenate([fresh[r], add_i >= 0], 1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
            ids[r], sims[r], fresh[r] = (np.take_along_axis(z, order, 1) for z in (all_i, all_s, all_f))
        return np.where(ids >= 0, at[np.maximum(ids, 0)], -1), sims
