"""Refinement of homographies: slopes against differences, sums that never fall, blocks against the whole."""

import numpy as np
import pytest

from courtflux.operators import court, refine
from courtflux.operators.refine import Chain, Goal


def _chain(rng, n=9, points=3, noise=0.004):
    """A slow camera's true homographies, points that fit them, and a noisy start."""
    step = np.array([[1.0, 0.001, 0.002], [0.0, 1.0, -0.001], [0.0005, 0.0, 1.0]])
    true = [np.array([[1.1, 0.02, -0.4], [0.01, 0.9, -0.45], [0.05, 0.03, 1.0]])]
    for _ in range(n - 1):
        true.append(true[-1] @ np.linalg.inv(step))
    true = np.array([m / np.linalg.norm(m) for m in true])
    of = np.repeat(np.arange(n), points)
    src = np.c_[rng.random((n * points, 2)), np.ones(n * points)]
    dst = np.einsum("pij,pj->pi", true[of], src)
    back = np.broadcast_to(np.linalg.inv(step), (n - 1, 3, 3)).copy()
    start = true + rng.normal(0, noise, true.shape)
    return true, start / np.sqrt((start * start).sum((1, 2), keepdims=True)), Chain(src, dst / dst[:, 2:], of, back, np.ones(n - 1, bool)), step


def test_objective_is_rewards_less_distances():
    true, start, c, _ = _chain(np.random.default_rng(1))
    c.on[3] = False
    want = sum(np.exp((x @ d / np.linalg.norm(x) / np.linalg.norm(d) - 1) / 0.003) for x, d in zip(np.einsum("pij,pj->pi", start[c.of], c.src), c.dst))
    for t in range(len(start) - 1):
        carried = start[t] @ c.back[t]
        want -= 200 * (court.distance(start[t + 1], carried) + court.distance(start[t + 1], carried, False)) * c.on[t]
    assert np.isclose(refine.objective(start, c, Goal()), want)
    assert np.isclose(refine.objective(true, _chain(np.random.default_rng(1))[2], Goal()), len(c.src))


def test_slopes_against_differences():
    """The gradient of rewards and distances, each number of each frame; a pair that is not tied takes no part."""
    _, start, c, _ = _chain(np.random.default_rng(2), n=4)
    c.on[1] = False
    slope = refine.normal_equations(start, c, Goal())[2].ravel()
    for k in range(slope.size):
        d = np.zeros(slope.size)
        d[k] = 1e-6
        up, down = (refine.objective(start + s * d.reshape(start.shape), c, Goal()) for s in (1, -1))
        assert np.isclose(-(up - down) / 2e-6, slope[k], rtol=1e-4, atol=1e-3)


def test_block_solve():
    rng = np.random.default_rng(3)
    for n in (1, 2, 6):
        a, b, x = rng.normal(0, 1, (n, 9, 9)), rng.normal(0, 0.3, (n - 1, 9, 9)), rng.normal(0, 1, (n, 9))
        a = a @ np.swapaxes(a, 1, 2) + 9 * np.eye(9)
        whole = np.zeros((9 * n, 9 * n))
        for t in range(n):
            whole[9 * t : 9 * t + 9, 9 * t : 9 * t + 9] = a[t]
        for t in range(n - 1):
            whole[9 * t : 9 * t + 9, 9 * t + 9 : 9 * t + 18] = b[t]
            whole[9 * t + 9 : 9 * t + 18, 9 * t : 9 * t + 9] = b[t].T
        assert np.allclose(refine.block_solve(a, b, x).ravel(), np.linalg.solve(whole, x.ravel()))


@pytest.mark.parametrize("wrong", [0, 5])
def test_sum_rises_and_truth_is_found(wrong):
    """From noise to the truth, three points a frame; points far off don't matter much. Fixed frames stay."""
    rng = np.random.default_rng(4)
    true, start, c, _ = _chain(rng, n=30)
    c.dst[rng.choice(len(c.dst), wrong, replace=False), :2] += 0.6
    values, h = [refine.objective(start, c, Goal())], start
    for _ in range(8):
        h = refine.refined(h, c, np.zeros(30, bool), steps=2)
        values.append(refine.objective(h, c, Goal()))
    assert all(b >= a for a, b in zip(values, values[1:])) and values[-1] > values[0]
    assert np.abs(h - true).max() < (1e-5 if not wrong else 2e-3) and np.abs(start - true).max() > 5e-3
    fixed = np.arange(30) % 7 == 0
    assert np.array_equal(refine.refined(start, c, fixed)[fixed], start[fixed] / np.sqrt((start[fixed] ** 2).sum((1, 2), keepdims=True)))


def test_tables(spark):
    """Blocks come near to what the whole reaches; missing homographies, a cut chain, a video without any, no rows."""
    rng = np.random.default_rng(5)
    true, start, c, step = _chain(rng, n=40)
    own = [None if t in (0, 17) else start[t].ravel().tolist() for t in range(40)]
    rows = [(1, t, own[t], None if t in (0, 25) else step.ravel().tolist()) for t in range(40)] + [(2, 0, None, None), (2, 1, None, step.ravel().tolist())]
    frames = spark.createDataFrame(rows, "video_id long, frame_id long, h array<double>, step array<double>")
    pts = [(1, int(t), *map(float, s[:2]), *map(float, d[:2])) for t, s, d in zip(c.of, c.src, c.dst)] + [(2, 0, 0.1, 0.1, 0.2, 0.2), (1, 3, None, 0.1, 0.2, 0.2), (1, 99, 0.1, 0.1, 0.2, 0.2)]
    points = spark.createDataFrame(pts, "video_id long, frame_id long, sx double, sy double, dx double, dy double")
    for block, rounds, near in ((256, 2, 1e-4), (16, 10, 5e-3)):
        got = {(r.video_id, r.frame_id): (r.h, r.reward) for r in refine.refine(frames, points, rounds=rounds, block=block).collect()}
        assert len(got) == 42 and got[2, 0] == got[2, 1] == (None, 0.0)
        for t in range(40):
            h, r = got[1, t]
            assert np.abs(np.array(h) - (true[t] / true[t, 2, 2]).ravel()).max() < near and abs(r - 3) < 1e-2
    assert refine.refine(frames.where("video_id > 5"), points).count() == 0


def test_chains_at_once_are_chains_alone(monkeypatch):
    """Chains of one frame and more, an untied frame, fixed frames, far points: each as if alone, and arrays are made once for all of them."""
    rng, parts = np.random.default_rng(6), []
    for n, wrong in ((1, 0), (12, 0), (7, 3), (2, 0), (20, 5)):
        _, start, c, _ = _chain(rng, n=n)
        c.dst[rng.choice(len(c.dst), wrong, replace=False), :2] += 0.6
        if n == 12:
            c.on[4] = False
        parts.append((start, c, np.arange(n) % 6 == 3))
    alone = [refine.refined(h, c, fixed) for h, c, fixed in parts]
    sizes = [len(h) for h, _, _ in parts]
    begins = np.cumsum([0, *sizes[:-1]])
    between = [np.eye(3)[None], np.zeros(1, bool)]
    back, on = ([x for _, c, _ in parts for x in (getattr(c, name), gap)][:-1] for name, gap in zip(("back", "on"), between))
    whole = Chain(*(np.concatenate([getattr(c, name) for _, c, _ in parts]) for name in ("src", "dst")), np.concatenate([c.of + b for (_, c, _), b in zip(parts, begins)]), np.concatenate(back), np.concatenate(on))
    made = []
    solve = refine.normal_equations
    monkeypatch.setattr(refine, "normal_equations", lambda *a: made.append(1) or solve(*a))
    got = refine.refined(np.concatenate([h for h, _, _ in parts]), whole, np.concatenate([f for _, _, f in parts]), begins=begins)
    assert np.allclose(got, np.concatenate(alone), atol=1e-8) and len(made) <= 10


def test_inverses_of_singular_matrices():
    m = np.array([np.eye(3), np.diag([1.0, 2.0, 0.0]), np.zeros((3, 3)), [[1, 2, 3], [0, 1, 4], [5, 6, 0]]], float)
    assert np.allclose(refine._inverse(m), np.linalg.pinv(m))
