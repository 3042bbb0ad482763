"""Fits of a frame take all their tries at once, and give the same homographies."""

import numpy as np

from courtflux.operators import court

H = np.array([[1.1, 0.02, -0.4], [0.01, 0.9, -0.45], [0.05, 0.03, 1.0]])


def fit_of(monkeypatch, make):
    monkeypatch.setattr(court, "_by_frame", lambda points, fit, seed: fit)
    return make(None)


def test_baseline(monkeypatch):
    fit, calls, apply = fit_of(monkeypatch, court.least_squares), [], court.apply
    monkeypatch.setattr(court, "apply", lambda h, p: calls.append(1) or apply(h, p))
    rng = np.random.default_rng(1)
    src = rng.random((12, 2))
    dst = apply(H, src)
    dst[::4] += 0.3
    assert np.allclose(fit(src, dst, 5), H, atol=1e-9) and fit(src[:3], dst[:3], 5) is None
    assert len(calls) <= 1  # one for each of 200 tries before


def test_first_four():
    x = np.random.default_rng(2).random((50, 33))
    assert (court.first_four(x) == x.argsort(1)[:, :4]).all() and (court.first_four(x[:, :5]) == x[:, :5].argsort(1)[:, :4]).all()


def test_ransac_without_slow_steps(monkeypatch):
    """Neither all of a try's points are sorted nor ``np.cross`` called; the homography is the exact one."""
    fit = lambda src, dst: court.ransac(src, dst, seed=3)
    src = np.random.default_rng(4).random((33, 2))
    dst = court.apply(H, src)
    dst[::4] += 0.3
    monkeypatch.setattr(np, "cross", None)
    assert np.allclose(fit(src, dst), H, atol=1e-9) and fit(src[:3], dst[:3]) is None
