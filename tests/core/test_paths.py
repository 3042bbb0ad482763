"""The flow of tracks a frame at a time: what the general flow gives, in much less time."""

import time

import numpy as np
import pytest

from courtflux.operators import assign


def made(rng, frames, most_rows, skip, singles):
    """Rows of frames, their links' costs (some infinite), and where paths may begin."""
    rows = rng.integers(1, most_rows + 1, frames)
    cut = np.concatenate([[0], np.cumsum(rows)])
    n, low = int(cut[-1]), cut[np.maximum(np.arange(frames) - skip, 0)]
    near = [np.where(rng.random((r, a - b)) < 0.8, rng.normal(0.6, 1, (r, a - b)), np.inf) for r, a, b in zip(rows, cut, low)]
    i = rng.integers(0, n, singles)
    j = rng.integers(0, n, singles)
    ok = np.searchsorted(cut, i, side="right") < np.searchsorted(cut, j, side="right")
    c = rng.normal(0.5, 1, singles)
    start = np.where(rng.random(n) < 0.5, rng.random(n), np.inf)
    return cut, low, near, i[ok], j[ok], c[ok], start, rng.random(n) * 2


def general(cut, low, near, i, j, c, start, end, most):
    n = len(start)
    g = assign.Flow(2 * n + 2)
    for d in range(n):
        g.edge(1 + 2 * d, 2 + 2 * d, 1, -1.0)
        if np.isfinite(start[d]):
            g.edge(0, 1 + 2 * d, 1, float(start[d]))
        g.edge(2 + 2 * d, 2 * n + 1, 1, float(end[d]))
    for f, m in enumerate(near):
        for (r, k), v in np.ndenumerate(m):
            if np.isfinite(v):
                g.edge(2 + 2 * (low[f] + k), 1 + 2 * (cut[f] + r), 1, float(v))
    for a, b, v in zip(i.tolist(), j.tolist(), c.tolist()):
        g.edge(2 + 2 * a, 1 + 2 * b, 1, v)
    return g.solve(0, 2 * n + 1, most)


def cost(p, start, end):
    return sum(start[t[0]] + end[t[-1]] - len(t) + p.cost[t[:-1]].sum() for t in p.paths())


@pytest.mark.parametrize("seed", range(40))
def test_as_the_general_flow(seed):
    rng = np.random.default_rng(seed)
    cut, low, near, i, j, c, start, end = made(rng, int(rng.integers(1, 9)), 4, int(rng.integers(1, 4)), int(rng.integers(0, 12)))
    most = int(rng.integers(1, 5))
    p = assign.Paths(cut, low, start, end, 1.0)
    p.price(near, i, j, c)
    p.solve(most)
    sent, total = general(cut, low, near, i, j, c, start, end, most)
    got = p.paths()
    assert len(got) == sent and np.isclose(cost(p, start, end), total) and len({r for t in got for r in t}) == sum(map(len, got))
    # Prices change: where the paths are said to be the cheapest still, they are.
    near = [m + rng.normal(0, 0.15, m.shape) for m in near]
    p.price(near, i, j, c)
    if len(got) == most and p.still_cheapest():
        assert np.isclose(cost(p, start, end), general(cut, low, near, i, j, c, start, end, most)[1])
    p.price([np.full(m.shape, np.inf) for m in near], i[:0], j[:0], c[:0])
    assert not p.still_cheapest() or all(len(t) == 1 for t in got)


def test_much_faster():
    rng = np.random.default_rng(7)
    rows, skip = 8, 15
    cut = np.arange(0, 8 * 101, rows)
    low = cut[np.maximum(np.arange(100) - skip, 0)]
    near = [np.where((np.arange(8)[:, None] == np.arange(a - b) % 8), 0.1 + 0.3 * ((a - b - 1 - np.arange(a - b)) // 8), 5.0) + rng.random((8, a - b)) * 0.1 for a, b in zip(cut[:-1], low)]
    start, end, none = np.where(np.arange(800) < 80, 2.0, np.inf), np.full(800, 2.0), np.empty(0, int)
    began = time.perf_counter()
    p = assign.Paths(cut, low, start, end, 1.0)
    p.price(near, none, none, np.empty(0))
    p.solve(8)
    took = time.perf_counter() - began
    began = time.perf_counter()
    sent, total = general(cut, low, near, none, none, np.empty(0), start, end, 8)
    assert sent == len(p.paths()) == 8 and np.isclose(cost(p, start, end), total)
    assert 2 * took < time.perf_counter() - began
