"""Refitting a block's segments: hypotheses are counted no further than they can win, and a level of segments is weighed at once."""

import numpy as np
import pytest

from courtflux.operators import chains, court

H = np.array([[1.1, 0.02, -0.4], [0.01, 0.9, -0.45], [0.05, 0.03, 1.0]])


def _points(n, seed, wrong=2):
    rng = np.random.default_rng(seed)
    src = rng.random((n, 2))
    dst = court.apply(H, src)
    off = rng.permutation(n)[: n * wrong // 5]
    dst[off] += rng.uniform(0.3, 0.9, (len(off), 2))
    return src, dst


@pytest.mark.parametrize("n, wrong", [(5, 2), (17, 2), (130, 2), (130, 4), (300, 5)])
def test_most_voted(n, wrong, monkeypatch):
    src, dst = _points(n, n, wrong)
    hyp = chains.hypotheses(src, dst, (1, 2))
    total = chains.votes(hyp, src, dst)
    got = chains.most_voted(hyp, src, dst)
    assert total[got] >= total.max() - 1e-9 * n
    counted, votes = [], chains.votes
    monkeypatch.setattr(chains, "votes", lambda h, s, *more: counted.append(len(h) * len(s)) or votes(h, s, *more))
    chains.most_voted(hyp, src, dst)
    assert n < 100 or wrong > 2 or sum(counted) < 0.7 * len(hyp) * n


def test_most_voted_takes_odd_numbers_as_before():
    src, dst = _points(40, 1)
    hyp = chains.hypotheses(src, dst, (1, 2))
    for place in (0, 39):
        off = dst.copy()
        off[place] = np.nan
        assert chains.most_voted(hyp, src, off) == 0
    hyp[7] = np.nan
    assert chains.most_voted(hyp, src, dst) == 7 and chains.most_voted(hyp[:3] * 0, src, dst) == 0


def test_drawn_fours():
    for n in (12, 13, 256):
        drawn = court.drawn_fours(n, 400, (1, n))
        assert drawn.shape == (400, 4) and drawn.min() >= 0 and drawn.max() == n - 1 and (np.diff(np.sort(drawn, 1), axis=1) > 0).all()
    many = court.drawn_fours(9, 100, 5)  # 126 fours
    counts = np.bincount(np.concatenate([court.drawn_fours(9, 100, s) for s in range(200)]).ravel(), minlength=9)
    assert many.shape == (100, 4) and np.abs(counts / counts.mean() - 1).max() < 0.05
    assert len(court.drawn_fours(6, 15, 0)) == 15


def test_four_points_give_their_homography():
    rng = np.random.default_rng(2)
    src, dst = rng.random((3, 50, 4, 2)), rng.random((3, 50, 4, 2))
    got = court.from_four(src, dst)
    to = np.einsum("abij,abpj->abpi", got, np.concatenate([src, np.ones((3, 50, 4, 1))], -1))
    assert got.shape == (3, 50, 3, 3) and np.allclose(to[..., :2] / to[..., 2:], dst, atol=1e-6)
    flat = np.array([[0.0, 0.0], [0.5, 0.5], [1.0, 1.0], [0.2, 0.7]])
    assert np.abs(np.linalg.det(court.from_four(flat[None], dst[0, :1]))).max() < 1e-12


def test_a_level_is_weighed_at_once(monkeypatch):
    frame, n = np.arange(16), 16
    of = np.repeat(frame, 5)
    src, dst = _points(80, 3)
    calls, jumps = [], chains.jumps
    monkeypatch.setattr(chains, "jumps", lambda *a, **k: calls.append(1) or jumps(*a, **k))
    eye = np.repeat(np.eye(3)[None], n, 0)
    h = chains.refit_block(np.full((n, 3, 3), np.nan), eye, eye, frame, src, dst, of, np.arange(80), 1, chains.Weights(), 16)
    assert np.abs(h - H).max() < 1e-5 and len(calls) == 4  # not one for each of 15 segments
