"""The model of many tracks against the joint Gaussian of all their states, written out."""

import numpy as np
import pytest

from courtflux.operators import em
from courtflux.operators.smooth import Kalman, generate


def _model(rng, d=2, o=1):
    root = lambda n: (lambda m: m @ m.T + 0.3 * np.eye(n))(rng.normal(0, 0.4, (n, n)))
    return Kalman(np.eye(d) * 0.9 + rng.normal(0, 0.1, (d, d)), rng.normal(0, 1, (o, d)), root(d), root(o), rng.normal(0, 1, d), root(d))


def _joint(k, z):
    """Posterior mean and covariance of states 0..n, and the log density of what was seen, from the whole covariance matrix."""
    n, d, o = len(z), len(k.mean), len(k.r)
    power = [np.linalg.matrix_power(k.a, i) for i in range(n + 1)]
    mean = np.concatenate([p @ k.mean for p in power])
    var = [k.cov]
    for _ in range(n):
        var.append(k.a @ var[-1] @ k.a.T + k.q)
    cov = np.zeros(((n + 1) * d, (n + 1) * d))
    for i in range(n + 1):
        for j in range(i + 1):
            c = power[i - j] @ var[j]
            cov[i * d : i * d + d, j * d : j * d + d] = c
            cov[j * d : j * d + d, i * d : i * d + d] = c.T
    on = [t for t in range(n) if not np.isnan(z[t]).any()]
    to = np.zeros((len(on) * o, (n + 1) * d))
    for r, t in enumerate(on):
        to[r * o : r * o + o, (t + 1) * d : (t + 2) * d] = k.h
    s = to @ cov @ to.T + np.kron(np.eye(len(on)), k.r)
    off = np.concatenate([z[t] for t in on]) - to @ mean if on else np.zeros(0)
    gain = cov @ to.T @ np.linalg.inv(s)
    ll = -0.5 * (len(off) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + off @ np.linalg.inv(s) @ off) if on else 0.0
    return (mean + gain @ off).reshape(n + 1, d), cov - gain @ to @ cov, ll


def _brute(k, tracks):
    d = len(k.mean)
    out = em.Statistics(*(np.zeros(s) for s in em.Statistics.shapes(d, len(k.r))))
    for z in tracks:
        x, c, ll = _joint(k, z)
        e = lambda i, j: c[i * d : i * d + d, j * d : j * d + d] + np.outer(x[i], x[j])
        for t in range(len(z)):
            out.before += e(t, t)
            out.after += e(t + 1, t + 1)
            out.cross += e(t + 1, t)
            if not np.isnan(z[t]).any():
                out.seen += e(t + 1, t + 1)
                out.with_seen += np.outer(z[t], x[t + 1])
                out.squares += np.outer(z[t], z[t])
                out.counts[1] += 1
        out.first += x[0]
        out.first_square += e(0, 0)
        out.counts += [len(z), 0, 1]
        out.likelihood += ll
    return out


@pytest.mark.parametrize("d,o", [(1, 1), (2, 1), (3, 2)])
def test_expected_statistics(d, o):
    """Tracks of unlike lengths, with gaps, one of them never seen."""
    rng = np.random.default_rng(d)
    k = _model(rng, d, o)
    tracks = [rng.normal(0, 1, (n, o)) for n in (1, 4, 7)] + [np.full((3, o), np.nan)]
    tracks[1][2] = tracks[2][0] = tracks[2][6] = np.nan
    assert np.allclose(em.expected(k, tracks).flat(), _brute(k, tracks).flat())


def test_fit_over_tables(spark, monkeypatch):
    """Equal to rounds of the written-out statistics over all tracks, for any cut into calls; the likelihood never falls."""
    rng = np.random.default_rng(5)
    true = Kalman(np.array([[0.95]]), np.eye(1), np.array([[0.2]]), np.array([[0.5]]), np.zeros(1), np.eye(1))
    tracks, rows = [], []
    for i in range(6):
        z = generate(true, 12 + i, seed=i)[1]
        z[rng.random(len(z)) < 0.2] = np.nan
        z[[0, -1]] = 0.5  # a track goes from its first row to its last
        there = [t for t, (x,) in enumerate(z) if t % 3 or not np.isnan(x)]
        tracks += [z[: max(t for t in there if t < 10) + 1], z[10:]]
        rows += [(i % 2, i, 100 + t, None if np.isnan(z[t, 0]) else float(z[t, 0])) for t in there]
    rows += [(None, 1, 1, 9.0), (0, 0, None, 9.0), (0, 0, 100, 0.5)]  # no key, no frame, a repeated row
    df = spark.createDataFrame(rows, "video_id long, player_id long, frame_id long, x double").repartition(3)
    start = Kalman(np.eye(1), np.eye(1), np.eye(1), np.eye(1), np.ones(1), np.eye(1))
    want, path = start, []
    for _ in range(4):
        s = _brute(want, tracks)
        path.append(float(s.likelihood[0]))
        want = em.maximised(want, s, ("h",))
    for cells in (20, 65536):
        monkeypatch.setattr(em, "CELLS", cells)
        got, found = em.fit(df, start, ["x"], 4, ("h",), length=10)
        assert np.allclose(found, path) and all(b >= a - 1e-9 for a, b in zip(found, found[1:]))
        assert all(np.allclose(getattr(got, p), getattr(want, p)) for p in em.PARAMETERS)
    assert {r.name for r in em.parameters(spark, got).collect()} == set(em.PARAMETERS)


def test_fit_of_nothing(spark):
    start = Kalman(np.eye(1), np.eye(1), np.eye(1), np.eye(1), np.ones(1), np.eye(1))
    got, path = em.fit(spark.createDataFrame([], "video_id long, player_id long, frame_id long, x double"), start, ["x"])
    assert got is start and path == []


def test_all_parameters_likelihood_rises():
    rng = np.random.default_rng(9)
    k, tracks = _model(rng, 2, 2), [rng.normal(0, 1, (20, 2)).cumsum(0) for _ in range(5)]
    path = []
    for _ in range(15):
        s = em.expected(k, tracks)
        path.append(float(s.likelihood[0]))
        k = em.maximised(k, s)
    assert all(b >= a - 1e-7 for a, b in zip(path, path[1:])) and path[-1] > path[0]
