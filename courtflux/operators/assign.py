"""Optimal one-to-one assignment, min-cost flow on graphs whose edges run forward, and on rows in order of time."""

from __future__ import annotations

from bisect import bisect_right
from heapq import heappop, heappush

import numpy as np


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of least total cost that pairs as many as the smaller side has.

    Where the rows' cheapest columns differ they are the answer. Else shortest augmenting paths with dual prices, one row at a time; each
    step relaxes a whole row.
    """
    c = np.asarray(cost, float)
    if c.size == 0:
        return np.empty(0, int), np.empty(0, int)
    turned = c.shape[0] > c.shape[1]
    if turned:
        c = c.T
    n, m = c.shape
    cheapest = c.argmin(1)
    if len(set(cheapest.tolist())) == n:
        if not turned:
            return np.arange(n), cheapest
        by = np.argsort(cheapest)
        return cheapest[by], by
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, j, reach = row, -1, 0.0
        while True:
            new = reach + c[at] - u[at] - v
            closer = ~done & (new < dist)
            dist[closer], via[closer] = new[closer], j
            j = int(np.where(done, np.inf, dist).argmin())
            reach, done[j] = dist[j], True
            if owner[j] < 0:
                break
            at = owner[j]
        inside = np.flatnonzero(done)
        shift = reach - dist[inside]
        for k, s in zip(inside, shift):
            if owner[k] >= 0:
                u[owner[k]] += s
            v[k] -= s
        u[row] += reach
        while j >= 0:
            before = via[j]
            owner[j] = owner[before] if before >= 0 else row
            j = before
    cols = np.flatnonzero(owner >= 0)
    rows = owner[cols]
    by = np.argsort(cols if turned else rows)
    return (cols[by], rows[by]) if turned else (rows[by], cols[by])


class Flow:
    """A graph of unit and larger capacities; nodes are numbered so that every edge runs to a larger number."""

    def __init__(self, nodes: int):
        self.n = nodes
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[float] = []

    def edge(self, a: int, b: int, cap: int, cost: float) -> int:
        """The edge's number; the one behind it is its reverse."""
        k = len(self.to)
        self.to += (b, a)
        self.cap += (cap, 0)
        self.cost += (cost, -cost)
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def solve(self, s: int, t: int, most: int) -> tuple[int, float]:
        """Sends up to ``most`` units, each along a cheapest path; also such as cost more than they gain.

        First prices come from one pass in node order (edges run forward), later ones from Dijkstra on reduced costs.
        """
        inf = float("inf")
        price = [inf] * self.n
        price[s] = 0.0
        for a in range(self.n):
            if price[a] < inf:
                for k in self.out[a]:
                    if self.cap[k] > 0 and price[a] + self.cost[k] < price[self.to[k]]:
                        price[self.to[k]] = price[a] + self.cost[k]
        sent, total = 0, 0.0
        while sent < most:
            dist, via = [inf] * self.n, [-1] * self.n
            dist[s] = 0.0
            heap = [(0.0, s)]
            while heap:
                d, a = heappop(heap)
                if d > dist[a] + 1e-12:
                    continue
                if a == t:  # what lies farther is priced as if it lay here
                    break
                base = d + price[a]
                for k in self.out[a]:
                    if self.cap[k] > 0:
                        b = self.to[k]
                        nd = base + self.cost[k] - price[b]
                        if nd < dist[b] - 1e-9:
                            dist[b], via[b] = nd, k
                            heappush(heap, (nd, b))
            if dist[t] == inf:
                break
            most_far = dist[t]
            for a in range(self.n):
                price[a] += min(dist[a], most_far)
            b = t
            while b != s:
                k = via[b]
                self.cap[k] -= 1
                self.cap[k ^ 1] += 1
                total += self.cost[k]
                b = self.to[k ^ 1]
            sent += 1
        return sent, total


class Paths:
    """Cheapest disjoint paths through rows in order of time: what ``Flow`` gives for such rows, a frame of rows at a time.

    Frames are runs of rows (``cut``, their bounds); a row of frame f may follow any of the rows from ``low[f]`` on. ``start``, ``end``: what a
    path that begins or ends at a row costs; ``gain``: what a row on a path earns.
    """

    TINY = 1e-9

    def __init__(self, cut: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, gain: float):
        self.cut, self.low, self.start, self.end, self.gain, self.n = cut.tolist(), low.tolist(), start, end, gain, len(start)
        self.next, self.prev = np.full(self.n, -1), np.full(self.n, -1)
        self.used, self.cost = np.zeros(self.n, bool), np.zeros(self.n)  # ``cost``: of the link to the row's next

    def price(self, near: list[np.ndarray], i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        """Costs of the links: for each frame a matrix of its rows and those that they may follow, and single links i, j, c beside them."""
        near, c = [np.where(np.isnan(x), np.inf, x) for x in near], np.where(np.isnan(c), np.inf, c)
        self.near = near
        best = np.lexsort((c, i, j))
        first = np.ones(len(best), bool)
        first[1:] = (i[best][1:] != i[best][:-1]) | (j[best][1:] != j[best][:-1])
        self.i, self.j, self.c = (x[best][first] for x in (i, j, c))
        rows, at = np.unique(self.j, return_index=True)
        frame = np.searchsorted(np.asarray(self.cut), rows, side="right") - 1
        self.far: dict[int, list[tuple[int, int, int]]] = {}
        for f, r, a, z in zip(frame.tolist(), rows.tolist(), at.tolist(), [*at.tolist()[1:], len(self.j)]):
            self.far.setdefault(f, []).append((r, a, z))
        self._reprice(np.flatnonzero(self.next >= 0))

    def _reprice(self, rows: np.ndarray) -> None:
        for r in rows.tolist():
            self.cost[r] = self._link(r, int(self.next[r]))

    def _link(self, i: int, j: int) -> float:
        f = bisect_right(self.cut, j) - 1
        c = float(self.near[f][j - self.cut[f], i - self.low[f]]) if self.low[f] <= i < self.cut[f] else float("inf")
        for r, a, z in self.far.get(f, ()):
            if r == j:
                k = a + int(np.searchsorted(self.i[a:z], i))
                if k < z and self.i[k] == i:
                    c = min(c, float(self.c[k]))
        return c

    def _forward(self, moved: np.ndarray) -> bool:
        """Frame after frame, what rows that moved (``out``) offer those that may follow them; whether any row came nearer."""
        into, out, via, cut, low = self.into, self.out, self.via, self.cut, self.low
        marks, recent, any_ = moved.tolist(), -1, False
        for f, near in enumerate(self.near):
            s, e, a = cut[f], cut[f + 1], low[f]
            closer = None
            if recent >= a and a < s:
                m = near + out[a:s]
                k = m.argmin(1)
                v = m[np.arange(e - s), k]
                closer = v < into[s:e] - self.TINY
                if closer.any():
                    rows = s + np.flatnonzero(closer)
                    into[rows], via[rows] = v[closer], a + k[closer]
                else:
                    closer = None
            if recent >= 0 and f in self.far:
                for r, x, z in self.far[f]:
                    m = out[self.i[x:z]] + self.c[x:z]
                    k = int(m.argmin())
                    if m[k] < into[r] - self.TINY:
                        into[r], via[r] = m[k], self.i[x + k]
                        closer = np.zeros(e - s, bool) if closer is None else closer
                        closer[r - s] = True
            if closer is not None:
                any_ = True
                rows = s + np.flatnonzero(closer)
                rows = rows[~self.used[rows]]
                out[rows] = into[rows] - self.gain
                if len(rows):
                    recent = e - 1
            if recent < e - 1 and True in marks[s:e]:
                recent = e - 1
        return any_

    def _back(self) -> np.ndarray:
        """Along the paths backwards, what taking their links away gives; the rows that moved."""
        moved = np.zeros(self.n, bool)
        rows = np.flatnonzero(self.next >= 0)
        some = rows[self.into[self.next[rows]] - self.cost[rows] < self.out[rows] - self.TINY]
        for j in some[::-1].tolist():
            while j >= 0:
                k = self.next[j]
                v = self.into[k] - self.cost[j]
                if not v < self.out[j] - self.TINY:
                    break
                j = self._freed(j, v, moved)
        return moved

    def _freed(self, j: int, v: float, moved: np.ndarray) -> int:
        """The row before j on its path, where giving j up as well comes cheaper; else -1."""
        self.out[j], moved[j] = v, True
        if v + self.gain < self.into[j] - self.TINY:
            self.into[j], self.via[j] = v + self.gain, -2
            return int(self.prev[j])
        return -1

    def _begin(self) -> np.ndarray:
        self.into, self.via = self.start.copy(), np.full(self.n, -1)
        self.out = np.where(self.used, np.inf, self.into - self.gain)
        return ~self.used & np.isfinite(self.into)

    def solve(self, most: int) -> None:
        """Sends up to ``most`` paths, each the cheapest that is left, where links of those before may be given up; also such as cost more than they earn."""
        self.next[:], self.prev[:], self.used[:] = -1, -1, False
        for _ in range(most):
            moved = self._begin()
            while True:
                self._forward(moved)
                moved = self._back()
                if not moved.any():
                    break
            total = self.out + self.end
            last = int(total.argmin()) if self.n else -1
            if last < 0 or not np.isfinite(total[last]):
                return
            self._take(last)

    def _take(self, j: int) -> None:
        """Changes the paths by the cheapest way that ends at row j."""
        cut, tied, freed, taken = [], [], [], []
        inside = False
        while True:
            if not inside:
                if self.used[j]:  # by giving up the link to the next
                    cut.append((j, int(self.next[j])))
                    j = int(self.next[j])
                else:
                    taken.append(j)
                inside = True
            i = int(self.via[j])
            if i == -1:
                break
            if i == -2:
                freed.append(j)
            else:
                tied.append((i, j))
                j = i
            inside = False
        for a, b in cut:
            self.next[a] = self.prev[b] = -1
        self.used[freed], self.used[taken] = False, True
        for a, b in tied:
            self.next[a], self.prev[b] = b, a
        self._reprice(np.array([a for a, _ in tied], int))

    def still_cheapest(self, rounds: int = 60) -> bool:
        """Whether no other paths, as many, cost less at the prices as they are now; False also if ``rounds`` don't tell."""
        if not np.isfinite(self.cost[self.next >= 0]).all():  # a link of the paths is gone
            return False
        firsts, lasts = np.flatnonzero(self.used & (self.prev < 0)), np.flatnonzero(self.used & (self.next < 0))
        moved = self._begin()
        for _ in range(rounds):
            changed = self._forward(moved)
            moved = self._back()
            most = (self.out + self.end).min()
            for b in lasts.tolist():  # another row may be the path's last
                v = most - self.end[b]
                if v < self.out[b] - self.TINY:
                    j = self._freed(b, v, moved)
                    while j >= 0:
                        v = self.into[self.next[j]] - self.cost[j]
                        j = self._freed(j, v, moved) if v < self.out[j] - self.TINY else -1
            if (self.into[firsts] < self.start[firsts] - self.TINY).any():
                return False
            if not moved.any() and not changed:
                return bool(np.isfinite(most))
        return False

    def paths(self) -> list[list[int]]:
        """The rows of each path, in order of their first ones."""
        out = []
        for d in np.flatnonzero(self.used & (self.prev < 0)).tolist():
            path = [d]
            while self.next[path[-1]] >= 0:
                path.append(int(self.next[path[-1]]))
            out.append(path)
        return out
