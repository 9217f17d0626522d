"""Hierarchical navigable small-world graphs in numpy, built and searched for many vectors at a time."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np

#: Links of a node above the ground layer (twice as many on it), beam while building, cells of the visited table.
LINKS, BUILD_BEAM, CELLS = 12, 48, 1 << 25
#: Beams go up to WIDE; queries that have as many links are compared with all nodes, so many nodes at a time.
WIDE, COLUMNS = 1024, 16_384
#: Queries of a search that are audited: so many with links, and as many others.
AUDITS = 32
#: Groups of linked nodes up to this size are compared pair by pair, larger ones by products of blocks.
SMALL_GROUP = 64


def _diverse(own: np.ndarray, ids: np.ndarray, sims: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """(b, c) candidates by falling similarity (-1: none) -> (b, keep): those nearer to the node than to what is kept
    already, then the nearest of the rest."""
    b, c = ids.shape
    out = np.full((b, keep), -1, np.int32)
    n = np.zeros(b, np.int64)
    took = np.zeros((b, c), bool)
    for j in range(c):
        cand = ids[:, j]
        v = x[np.maximum(cand, 0)]
        near = np.einsum("bkd,bd->bk", x[np.maximum(out, 0)], v)
        near[out < 0] = -2
        ok = (cand >= 0) & (n < keep) & (near.max(1) < sims[:, j])
        at = np.flatnonzero(ok)
        out[at, n[at]] = cand[at]
        n[at] += 1
        took[at, j] = True
        if (n == keep).all():
            return out
    for j in range(c):
        at = np.flatnonzero(~took[:, j] & (ids[:, j] >= 0) & (n < keep))
        out[at, n[at]] = ids[at, j]
        n[at] += 1
    return out


class Graph:
    """Vectors of length one (float64, kept for exact checks; float32 for walking) and links by layer."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.exact = x
        self.x = x.astype(np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes of the layer; links as node numbers, -1: none
        for l in range(int(level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(level >= l).astype(np.int32)
            self._build(nodes, 2 * LINKS if l == 0 else LINKS)

    def _build(self, nodes: np.ndarray, width: int) -> None:
        links = np.full((len(self.x), width), -1, np.int32)
        order = np.random.default_rng(len(nodes)).permutation(nodes)
        above = self.layers[-1][0] if self.layers else np.zeros(0, np.int32)
        # What the layer above holds goes in first, so that its nodes are ways in.
        order = np.concatenate([order[np.isin(order, above)], order[~np.isin(order, above)]])
        self.layers.append((order[:1], links))
        done = 0
        while done < len(order):
            new = order[done : done + max(64, min(512, done))]
            ids, sims = self._beam(self.x[new], BUILD_BEAM) if done else (np.full((len(new), 1), -1, np.int32), np.full((len(new), 1), -2, np.float32))
            mates = self.x[new] @ self.x[new].T
            np.fill_diagonal(mates, -2)
            k = min(len(new), BUILD_BEAM)
            top = np.argsort(-mates, axis=1)[:, :k]
            ids = np.hstack([ids, np.where(np.take_along_axis(mates, top, 1) > -2, new[top], -1).astype(np.int32)])
            sims = np.hstack([sims, np.take_along_axis(mates, top, 1)])
            by = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            links[new] = _diverse(new, np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1), self.x, width)
            self._back(new, links, width)
            done += len(new)
            self.layers[-1] = (order[:done], links)

    def _back(self, new: np.ndarray, links: np.ndarray, width: int) -> None:
        """Links in the other direction; nodes with too many choose anew."""
        to, frm = links[new].ravel(), np.repeat(new, width)
        frm, to = frm[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        to, frm = to[by], frm[by]
        heads, begin, count = np.unique(to, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        for i in range(0, len(heads), 2048):
            h, b, c = heads[i : i + 2048], begin[i : i + 2048], count[i : i + 2048]
            at = b[:, None] + np.arange(most)[None, :]
            more = np.where(np.arange(most)[None, :] < c[:, None], frm[np.minimum(at, len(frm) - 1)], -1)
            ids = np.hstack([links[h], more])
            # The same link may come twice.
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("bkd,bd->bk", self.x[np.maximum(ids, 0)], self.x[h])
            sims[ids < 0] = -2
            o = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
            full = (ids >= 0).sum(1) > width
            links[h[~full]] = ids[~full, :width]
            if full.any():
                links[h[full]] = _diverse(h[full], ids[full], sims[full], self.x, width)

    def _layer(self, q: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk on one layer from entries (b, e); the beam's ids and similarities."""
        b, width = len(q), links.shape[1]
        rows = np.arange(b)
        seen = np.zeros((b, len(self.x) + 1), bool)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -2, np.float32)
        e = entry[:, :beam]
        ids[:, : e.shape[1]] = e
        s = np.einsum("bkd,bd->bk", self.x[np.maximum(e, 0)], q)
        s[e < 0] = -2
        sims[:, : e.shape[1]] = s
        seen[rows[:, None], np.where(e < 0, len(self.x), e)] = True
        open_ = sims > -2
        live = rows
        while len(live):
            pick = np.where(open_[live], sims[live], -3).argmax(1)
            going = open_[live, pick]
            live, pick = live[going], pick[going]
            if not len(live):
                break
            open_[live, pick] = False
            near = links[ids[live, pick]]
            slot = np.where(near < 0, len(self.x), near)
            fresh = ~seen[live[:, None], slot] & (near >= 0)
            seen[live[:, None], slot] = True
            s = np.einsum("bkd,bd->bk", self.x[np.maximum(near, 0)], q[live])
            s[~fresh] = -2
            useful = (s > sims[live].min(1, keepdims=True)).any(1)
            if not useful.any():
                continue
            r = live[useful]
            alls = np.hstack([sims[r], s[useful]])
            alli = np.hstack([ids[r], near[useful]])
            allo = np.hstack([open_[r], fresh[useful]])
            top = np.argpartition(-alls, beam - 1, axis=1)[:, :beam]
            sims[r], ids[r], open_[r] = np.take_along_axis(alls, top, 1), np.take_along_axis(alli, top, 1), np.take_along_axis(allo, top, 1)
        return np.where(sims > -2, ids, -1), sims

    def _beam(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the layers: a few ways in from each to the next, then the whole beam."""
        ids, sims = [], []
        step = max(1, CELLS // (len(self.x) + 1))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            entry = np.repeat(self.layers[0][0][:1][None, :], len(part), 0)
            for k, (nodes, links) in enumerate(self.layers):
                last = k == len(self.layers) - 1
                got, s = self._layer(part, links, entry, beam if last else min(8, beam))
                entry = got
            ids.append(got), sims.append(s)
        return np.vstack(ids), np.vstack(sims)

    def found(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """q: float64 queries of length one -> (query, node) of all links found with cosine >= least, in double precision; and
        the queries that have too many links for a beam of WIDE, for which there is none.

        A query whose whole beam lies above the threshold runs again with a beam twice as wide.
        """
        f = q.astype(np.float32)
        left, now = np.arange(len(q)), beam
        qs, ns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left) and now <= max(WIDE, beam):
            now = min(now, len(self.x))
            ids, sims = self._beam(f[left], now)
            full = (sims >= least - 1e-5).all(1) & (now < len(self.x))
            r, c = np.nonzero((sims >= least - 1e-5) & ~full[:, None])
            qs.append(left[r]), ns.append(ids[r, c].astype(np.int64))
            left, now = left[full], now * 2
        a, b = np.concatenate(qs), np.concatenate(ns)
        ok = np.zeros(len(a), bool)
        for i in range(0, len(a), 100_000):
            ok[i : i + 100_000] = np.einsum("kd,kd->k", q[a[i : i + 100_000]], self.exact[b[i : i + 100_000]]) >= least
        a, b = a[ok], b[ok]
        by = np.argsort(a, kind="stable")
        return a[by], b[by], left

    def all_links(self, q: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each query and some of its linked nodes, all of them in the end, by exact products of blocks."""
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            for j in range(0, len(self.exact), COLUMNS):
                hit = part @ self.exact[j : j + COLUMNS].T >= least
                for k in np.flatnonzero(hit.any(1)).tolist():
                    yield i + k, j + np.flatnonzero(hit[k])

    def groups(self, least: float) -> np.ndarray:
        """Each node's group: nodes that ground links of cosine >= least connect, named by their smallest node."""
        nodes, links = self.layers[-1]
        frm, to = np.repeat(nodes, links.shape[1]), links[nodes].ravel()
        frm, to = frm[to >= 0].astype(np.int64), to[to >= 0].astype(np.int64)
        ok = np.zeros(len(frm), bool)
        for i in range(0, len(frm), 100_000):
            ok[i : i + 100_000] = np.einsum("kd,kd->k", self.exact[frm[i : i + 100_000]], self.exact[to[i : i + 100_000]]) >= least
        frm, to = frm[ok], to[ok]
        label = np.arange(len(self.x))
        while True:
            before = label.copy()
            np.minimum.at(label, frm, before[to])
            np.minimum.at(label, to, before[frm])
            # Names are followed to their own names, so chains take few rounds.
            while (label[label] != label).any():
                label = label[label]
            if (label == before).all():
                return label

    def completed(self, q: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (query a, node b) -> these and all others into the groups that they reach: a query that links with one node of a
        group is compared exactly with the whole group, so that no link depends on the side that looked for it."""
        if not len(a):
            return a, b
        order = np.argsort(label, kind="stable")
        begin = np.searchsorted(label[order], np.arange(len(label)))
        size = np.bincount(label, minlength=len(label))
        query, group = np.divmod(np.unique(a * np.int64(len(label)) + label[b]), len(label))
        qs, ns = [], []

        def keep(k: np.ndarray, n: np.ndarray) -> None:
            ok = np.einsum("kd,kd->k", q[k], self.exact[n]) >= least
            qs.append(k[ok]), ns.append(n[ok])

        small = size[group] <= SMALL_GROUP
        k, g = query[small], group[small]
        for i in range(0, len(k), 2_000):
            n = size[g[i : i + 2_000]]
            at = np.repeat(begin[g[i : i + 2_000]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keep(np.repeat(k[i : i + 2_000], n), order[at])
        for g in np.unique(group[~small]).tolist():
            k = query[group == g]
            nodes = order[begin[g] : begin[g] + size[g]]
            for j in range(0, len(nodes), COLUMNS):
                part = self.exact[nodes[j : j + COLUMNS]].T
                for i in range(0, len(k), 256):
                    r, c = np.nonzero(q[k[i : i + 256]] @ part >= least)
                    qs.append(k[i + r]), ns.append(nodes[j + c])
        a, b = np.concatenate(qs), np.concatenate(ns)
        by = np.argsort(a, kind="stable")
        return a[by], b[by]

    def search(self, q: np.ndarray, own: np.ndarray, weight: np.ndarray, least: float, beam: int, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries (own: which node each is, -1: none) -> how many others each links with, by the nodes' weights; (query,
        node) links that connect all that is linked; and how many links the audits looked for and found.

        A query that links with one node of a group (see groups) is compared with the whole group. Audits compare some queries
        with all nodes, other than themselves; as long as less than `recall` of their links is found, the beams of all
        widen, and if the widest don't reach it, all queries are compared with all nodes. Links within what the search has
        connected already are counted, but not given.
        """
        groups = self.groups(least)
        while True:
            a, b, dense = self.found(q, least, beam)
            a, b = self.completed(q, a, b, least, groups)
            other = b != own[a]
            a, b = a[other], b[other]
            rng = np.random.default_rng(len(q))
            linked, alone = np.unique(a), np.setdiff1d(np.arange(len(q)), np.concatenate([a, dense]))
            audit = np.concatenate([rng.permutation(linked)[:AUDITS], rng.permutation(alone)[:AUDITS]])
            there = there_found = 0
            for k, nodes in self.all_links(q[audit], least):
                nodes = nodes[nodes != own[audit[k]]]
                there += len(nodes)
                there_found += int(np.isin(nodes, b[np.searchsorted(a, audit[k]) : np.searchsorted(a, audit[k], "right")]).sum())
            if there_found >= recall * there:
                break
            if beam >= min(WIDE, len(self.x)):
                a, b, dense = a[:0], b[:0], np.arange(len(q))
                there_found = there
                break
            beam *= 2
        count = np.zeros(len(q), np.int64)
        label = np.arange(len(self.x))
        src: list[np.ndarray] = []
        dst: list[np.ndarray] = []

        def link(k: int, nodes: np.ndarray) -> None:
            count[k] += weight[nodes].sum()
            roots, first = np.unique(label[nodes], return_index=True)
            if own[k] >= 0:
                first = first[roots != label[own[k]]]
                roots = np.append(roots, label[own[k]])
            if len(first):
                src.append(np.full(len(first), k)), dst.append(nodes[first])
            if len(set(roots.tolist())) > 1:
                low = roots.min()
                for i in range(0, len(roots), 4096):
                    label[np.isin(label, roots[i : i + 4096])] = low

        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(a)], strict=False):
            link(int(a[i]), b[i:j])
        for k, nodes in self.all_links(q[dense], least):
            nodes = nodes[nodes != own[dense[k]]]
            if len(nodes):
                link(int(dense[k]), nodes)
        none = [np.zeros(0, np.int64)]
        return count, np.concatenate(src or none), np.concatenate(dst or none), np.array([there, there_found])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, exact=self.exact, **{f"n{k}": n for k, (n, _) in enumerate(self.layers)}, **{f"l{k}": l if k == len(self.layers) - 1 else l[np.sort(n)] for k, (n, l) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        g = cls.__new__(cls)
        g.exact = z["exact"]
        g.x = g.exact.astype(np.float32)
        g.layers = []
        k = 0
        while f"n{k}" in z:
            n, l = z[f"n{k}"], z[f"l{k}"]
            if f"n{k + 1}" in z:
                full = np.full((len(g.x), l.shape[1]), -1, np.int32)
                full[np.sort(n)] = l
                l = full
            g.layers.append((n, l))
            k += 1
        return g
