"""Ball trees over labelled integer vectors, searched by branch and bound for many queries at a time."""

from __future__ import annotations

import io

import numpy as np

#: Rows of a leaf at most; rows that are compared with queries at a time; pairs of query and node that are held at a time.
LEAF, SPAN, PAIRS = 32, 1 << 16, 1 << 22
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """Rows (integers as float64), ids and labels, in the order of the leaves; a node is a range of them with its centre,
    radius, smallest id, and smallest and largest label.

    Labels are told apart first, then the rows of a label by the direction in which they spread most, and equal rows
    by id. So nodes hold one label wherever it has many rows, and copies end in nodes of radius zero.
    """

    FIELDS = ("x", "ids", "labels", "lo", "hi", "left", "right", "centre", "radius", "least", "label_min", "label_max")

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.lexsort((ids, labels))
        nodes: list[list] = []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            at = order[a:b]
            rows, labs = x[at], labels[at]
            centre = rows.mean(0)
            far = np.sqrt(((rows - centre) ** 2).sum(1))
            radius = float(far.max())
            if radius == 0 or (rows == rows[0]).all():
                centre, radius = rows[0], 0.0
            me = len(nodes)
            nodes.append([a, b, -1, -1, centre, radius, ids[at].min(), labs.min(), labs.max()])
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
            if b - a <= LEAF:
                continue
            if labs[0] != labs[-1]:
                # Rows of a node with several labels are still sorted by label.
                bounds = np.flatnonzero(labs[1:] != labs[:-1]) + 1
                mid = int(bounds[np.argmin(np.abs(bounds - (b - a) // 2))])
            else:
                mid = (b - a) // 2
                if radius == 0:
                    order[a:b] = at[np.argsort(ids[at], kind="stable")]
                else:
                    p = rows[int(far.argmax())]
                    q = rows[int(((rows - p) ** 2).sum(1).argmax())]
                    order[a:b] = at[np.lexsort((ids[at], rows @ (q - p)))]
            todo += [(a + mid, b, me), (a, a + mid, me)]
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.lo, self.hi, self.left, self.right = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
        self.centre, self.radius = np.array([n[4] for n in nodes]).reshape(len(nodes), -1), np.array([n[5] for n in nodes])
        self.least, self.label_min, self.label_max = (np.array([n[i] for n in nodes], np.int64) for i in (6, 7, 8))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        t = cls.__new__(cls)
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            for f in cls.FIELDS:
                setattr(t, f, z[f])
        return t


class Best:
    """Queries, and the best k rows of each so far by falling score, ties by id.

    A query is a vector, the id that it leaves out, a label, whether rows must have that label or any other, and the least and
    largest score that rows may have.
    """

    def __init__(self, vectors: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int):
        self.q, self.own, self.labels, self.same, self.low, self.high, self.k = vectors, own, labels, same, low, high, k
        self.norm = np.sqrt((vectors**2).sum(1))
        self.scores = np.full((len(own), k), _LOW)
        self.ids = np.full((len(own), k), _HIGH)
        self.filled = np.zeros(len(own), np.int64)

    def _may(self, t: BallTree, qi: np.ndarray, node: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a node whose scores are at most `most` can still hold one of the best: not strictly beneath the current
        kth, nor as good with larger ids only."""
        top = np.minimum(most, self.high[qi])
        kth, kid = self.scores[qi, -1], self.ids[qi, -1]
        return (top > kth) | ((top == kth) & (t.least[node] < kid)) | (self.filled[qi] < self.k)

    def _bounds(self, t: BallTree, qi: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest inner products that a node's ball allows: integers, so rounded inwards."""
        low, high = np.empty(len(qi)), np.empty(len(qi))
        for i in range(0, len(qi), SPAN):
            a, n = qi[i : i + SPAN], node[i : i + SPAN]
            mid = np.einsum("pd,pd->p", t.centre[n], self.q[a])
            reach = t.radius[n] * self.norm[a]
            slack = 1e-6 + 1e-12 * (np.sqrt((t.centre[n] ** 2).sum(1)) * self.norm[a] + reach)
            low[i : i + SPAN], high[i : i + SPAN] = np.ceil(mid - reach - slack), np.floor(mid + reach + slack)
        edge = 9.2e18
        return np.clip(low, -edge, edge).astype(np.int64), np.clip(high, -edge, edge).astype(np.int64)

    def search(self, t: BallTree) -> int:
        """Takes the tree's rows into account; the number of rows that were compared."""
        if t.x.shape[1] != self.q.shape[1]:
            return 0
        block = max(16, PAIRS // max(1, len(t.lo)))
        return sum(self._search(t, np.arange(i, min(i + block, len(self.own)))) for i in range(0, len(self.own), block))

    def _search(self, t: BallTree, qi: np.ndarray) -> int:
        node = np.zeros(len(qi), np.int64)
        leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(qi):
            a, b, l = t.label_min[node], t.label_max[node], self.labels[qi]
            fit = (a <= l) & (l <= b) if self.same else (a != l) | (b != l)
            qi, node = qi[fit], node[fit]
            least, most = self._bounds(t, qi, node)
            fit = (most >= self.low[qi]) & (least <= self.high[qi]) & self._may(t, qi, node, most)
            qi, node, most = qi[fit], node[fit], most[fit]
            leaf = t.left[node] < 0
            leaves.append((qi[leaf], node[leaf], most[leaf]))
            qi, node = np.repeat(qi[~leaf], 2), np.stack([t.left[node[~leaf]], t.right[node[~leaf]]], 1).ravel()
        qi, node, most = (np.concatenate(x) for x in zip(*leaves, strict=True))
        # Each query's most promising leaves first; some at a time, then the kth best tells which of the rest to see.
        order = np.lexsort((t.least[node], -np.minimum(most, self.high[qi]), qi))
        qi, node, most = qi[order], node[order], most[order]
        seen, width = 0, 2
        while len(qi):
            first = np.r_[True, qi[1:] != qi[:-1]]
            place = np.arange(len(qi)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            now = place < width
            seen += self._compare(t, qi[now], node[now])
            qi, node, most = qi[~now], node[~now], most[~now]
            fit = self._may(t, qi, node, most)
            qi, node, most = qi[fit], node[fit], most[fit]
            width *= 2
        return seen

    def _compare(self, t: BallTree, qi: np.ndarray, node: np.ndarray) -> int:
        """Each query with all rows of its leaf; queries of a leaf in one product."""
        order = np.argsort(node, kind="stable")
        qi, node = qi[order], node[order]
        begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]).tolist()
        seen, held, size = 0, [], 0
        for i, j in zip(begins, [*begins[1:], len(node)], strict=True):
            a, b = t.lo[node[i]], t.hi[node[i]]
            for k in range(i, j, SPAN // LEAF):
                owner = qi[k : min(j, k + SPAN // LEAF)]
                scores = self._scores(t.x[a:b], owner)
                # Most rows are beaten already.
                who, row = np.nonzero((scores >= np.maximum(self.scores[owner, -1], self.low[owner])[:, None]) & (scores <= self.high[owner][:, None]))
                held.append((owner[who], scores[who, row], a + row))
                size += len(who)
                seen += scores.size
                if size >= SPAN:
                    self._take(t, held)
                    held, size = [], 0
        if size:
            self._take(t, held)
        return seen

    def _scores(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        q = self.q[owner]
        if np.sqrt((x**2).sum(1).max(initial=0)) * self.norm[owner].max(initial=0) < 2**52:
            return np.rint(q @ x.T).astype(np.int64)
        exact = [[sum(int(u) * int(v) for u, v in zip(a, b, strict=True)) for b in x] for a in q]
        return np.array([[min(max(s, -(2**62)), 2**62) for s in r] for r in exact], np.int64)

    def _take(self, t: BallTree, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Keeps the best k of what is held and found."""
        owner, scores, rows = (np.concatenate(c) for c in zip(*found, strict=True))
        ids, labels = t.ids[rows], t.labels[rows]
        kth, kid = self.scores[owner, -1], self.ids[owner, -1]
        better = (scores > kth) | ((scores == kth) & (ids < kid))
        fit = ((labels == self.labels[owner]) == self.same) & (ids != self.own[owner]) & better
        owner, scores, ids = owner[fit], scores[fit], ids[fit]
        if not len(owner):
            return
        who, n = np.unique(owner), self.filled
        held = np.repeat(who, n[who])
        at = np.arange(len(held)) - np.repeat(np.cumsum(n[who]) - n[who], n[who])
        owner, scores, ids = np.r_[held, owner], np.r_[self.scores[held, at], scores], np.r_[self.ids[held, at], ids]
        order = np.lexsort((ids, -scores, owner))
        owner, scores, ids = owner[order], scores[order], ids[order]
        first = np.r_[True, owner[1:] != owner[:-1]]
        place = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = place < self.k
        self.scores[owner[keep], place[keep]], self.ids[owner[keep], place[keep]] = scores[keep], ids[keep]
        np.maximum.at(self.filled, owner[keep], place[keep] + 1)
