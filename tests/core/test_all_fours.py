"""Few points: every four of them is tried, and none twice."""

import numpy as np

from courtflux.operators import chains, court


def test_fours():
    assert len({tuple(x) for x in court.fours(6, 15, 0)}) == 15 == len(court.fours(6, 15, 0))
    drawn = court.fours(6, 14, 3)
    assert drawn.shape == (14, 4) and all(len(set(x)) == 4 for x in drawn)


def test_each_four_once(monkeypatch):
    made = []
    monkeypatch.setattr(court, "from_four", lambda a, b, f=court.from_four: made.append(len(a)) or f(a, b))
    h = np.array([[1.1, 0.02, -0.4], [0.01, 0.9, -0.45], [0.05, 0.03, 1.0]])
    src = np.random.default_rng(1).random((6, 2))
    dst = court.apply(h, src)
    dst[2] += 0.3
    assert np.abs(court.ransac(src, dst) - h).max() < 1e-6 and made == [15]
    assert len(chains.hypotheses(src, dst, (1, 2))) == 15


def test_votes_are_those_of_directions():
    rng = np.random.default_rng(2)
    h, src, dst = rng.normal(size=(7, 3, 3)), rng.random((600, 2)), rng.random((600, 2))
    a, b = chains._unit(chains.homogeneous(src) @ np.swapaxes(h, 1, 2)), chains._unit(chains.homogeneous(dst))
    want = np.exp((np.abs((a * b).sum(-1)) - 1) / 0.3**2).sum(1)
    assert np.allclose(chains.votes(h, src, dst, 0.3), want)
