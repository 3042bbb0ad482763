"""One linear-Gaussian model of many tracks, fitted by expectation-maximisation.

A round is one pass over the tracks: tasks find the expected statistics of their own tracks and emit a single row of sums, which Spark adds
up; the driver gets one row of a size that depends on the model alone and finds the next parameters from it.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, written
from .smooth import Kalman

#: Steps of tracks that one call of the E-step holds.
CELLS = 65536
PARAMETERS = ("a", "h", "q", "r", "mean", "cov")


@dataclass
class Statistics:
    """Sums over tracks: of the states' products, of products with observations, of first states, and the counts that go with them."""

    before: np.ndarray  # x[t-1] x[t-1]'
    after: np.ndarray  # x[t] x[t]'
    cross: np.ndarray  # x[t] x[t-1]'
    seen: np.ndarray  # x[t] x[t]' where something was observed
    with_seen: np.ndarray  # z[t] x[t]'
    squares: np.ndarray  # z[t] z[t]'
    first: np.ndarray
    first_square: np.ndarray
    counts: np.ndarray  # steps, observations, tracks
    likelihood: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(x) for x in vars(self).values()])

    @staticmethod
    def shapes(d: int, o: int) -> list[tuple[int, ...]]:
        return [(d, d)] * 4 + [(o, d), (o, o), (d,), (d, d), (3,), (1,)]

    @classmethod
    def of(cls, flat: np.ndarray, d: int, o: int) -> Statistics:
        shapes = cls.shapes(d, o)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*(x.reshape(s) for x, s in zip(np.split(flat, cuts), shapes)))


def expected(model: Kalman, tracks: list[np.ndarray]) -> Statistics:
    """The E-step for tracks of observations (steps x parts, nan: nothing seen), all tracks a step at a time.

    The model's first state lies a step before the first observation, as in ``Kalman.filter``; a step without observation has no update.
    """
    d, o, n = len(model.mean), len(model.r), len(tracks)
    size = np.array([len(z) for z in tracks])
    steps = int(size.max())
    z = np.full((n, steps, o), np.nan)
    for i, own in enumerate(tracks):
        z[i, : len(own)] = own
    there = ~np.isnan(z).any(2)
    z = np.where(there[..., None], z, 0.0)
    m, p = np.empty((steps + 1, n, d)), np.empty((steps + 1, n, d, d))
    m0, p0 = np.empty((steps, n, d)), np.empty((steps, n, d, d))
    m[0], p[0] = model.mean, model.cov
    likelihood = 0.0
    eye = np.eye(d)
    for t in range(steps):
        m0[t], p0[t] = m[t] @ model.a.T, model.a @ p[t] @ model.a.T + model.q
        on = there[:, t]
        spread = model.h @ p0[t] @ model.h.T + model.r
        back = np.linalg.inv(spread)
        off = z[:, t] - m0[t] @ model.h.T
        gain = p0[t] @ model.h.T @ back
        m[t + 1] = m0[t] + np.where(on[:, None], (gain @ off[..., None])[..., 0], 0.0)
        p[t + 1] = np.where(on[:, None, None], (eye - gain @ model.h) @ p0[t], p0[t])
        each = -0.5 * (o * np.log(2 * np.pi) + np.linalg.slogdet(spread)[1] + np.einsum("ni,nij,nj->n", off, back, off))
        likelihood += float(each[on].sum())
    s, v, cross = m.copy(), p.copy(), np.zeros((d, d))
    for t in range(steps - 1, -1, -1):
        inside = (t < size)[:, None]
        g = p[t] @ model.a.T @ np.linalg.inv(p0[t])
        s[t] += np.where(inside, (g @ (s[t + 1] - m0[t])[..., None])[..., 0], 0.0)
        v[t] += np.where(inside[..., None], g @ (v[t + 1] - p0[t]) @ np.swapaxes(g, 1, 2), 0.0)
        both = v[t + 1] @ np.swapaxes(g, 1, 2) + s[t + 1][:, :, None] * s[t][:, None, :]
        cross += both[inside[:, 0]].sum(0)
    second = v + s[..., :, None] * s[..., None, :]
    inside = np.arange(steps)[:, None] < size
    on = there.T
    return Statistics(
        second[:-1][inside].sum(0), second[1:][inside].sum(0), cross, second[1:][on].sum(0),
        np.einsum("nti,tnj->ij", z, np.where(on[..., None], s[1:], 0.0)), np.einsum("nti,ntj->ij", z, z),
        s[0].sum(0), second[0].sum(0), np.array([size.sum(), there.sum(), n], float), np.array([likelihood]),
    )


def _residual(squares: np.ndarray, by: np.ndarray, mixed: np.ndarray, own: np.ndarray, n: float) -> np.ndarray:
    """The covariance of y - by x from sums of y y', y x' and x x'."""
    c = (squares - by @ mixed.T - mixed @ by.T + by @ own @ by.T) / n
    return (c + c.T) / 2


def maximised(model: Kalman, s: Statistics, fixed: Collection[str] = ()) -> Kalman:
    """The M-step; parameters named in ``fixed`` stay. Without any observation ``h`` and ``r`` stay."""
    steps, seen, tracks = s.counts
    new = {k: getattr(model, k) for k in PARAMETERS}
    if "a" not in fixed:
        new["a"] = s.cross @ np.linalg.inv(s.before)
    if "q" not in fixed:
        new["q"] = _residual(s.after, new["a"], s.cross, s.before, steps)
    if seen and "h" not in fixed:
        new["h"] = s.with_seen @ np.linalg.inv(s.seen)
    if seen and "r" not in fixed:
        new["r"] = _residual(s.squares, new["h"], s.with_seen, s.seen, seen)
    if "mean" not in fixed:
        new["mean"] = s.first / tracks
    if "cov" not in fixed:
        m, f = new["mean"], s.first / tracks
        c = s.first_square / tracks - np.outer(m, f) - np.outer(f, m) + np.outer(m, m)
        new["cov"] = (c + c.T) / 2
    return Kalman(**new)


def sequences(rows: DataFrame, keys: list[str], values: list[str], length: int) -> DataFrame:
    """Tracks as rows of arrays: (keys, part, z), z the values of the part's frames in order, nan where a frame is missing or has a null.

    A track is cut into parts of at most ``length`` frames from its first on, each a sequence of its own that ends at its last row, so that no
    group holds an endless track. Of rows with one frame the least values count; rows without key or frame are left out.
    """
    some = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, "frame_id"]))
    one = some.groupBy(*keys, "frame_id").agg(F.min(F.struct(*(F.col(v).cast("double").alias(v) for v in values))).alias("v"))
    first = one.groupBy(*keys).agg(F.min("frame_id").alias("__first"))
    at = one.join(first, keys).withColumn("__at", F.col("frame_id") - F.col("__first")).withColumn("part", F.floor(F.col("__at") / length))
    each = at.groupBy(*keys, "part").agg(F.map_from_entries(F.collect_list(F.struct((F.col("__at") % length).alias("k"), F.col("v").alias("v")))).alias("m"))
    last = F.array_max(F.map_keys("m"))
    cell = lambda k: F.array(*(F.coalesce(F.try_element_at("m", k)[v], F.lit(float("nan"))) for v in values))
    return each.select(*keys, "part", F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), last), cell)).alias("z"))


def fit(rows: DataFrame, model: Kalman, values: list[str], rounds: int = 10, fixed: Collection[str] = (), keys: tuple[str, ...] = ("video_id", "player_id"), length: int = 4096) -> tuple[Kalman, list[float]]:
    """The model after ``rounds`` of expectation-maximisation over all tracks, and each round's log-likelihood, which never falls.

    ``rows`` have the keys of a track, frame_id and ``values``, the parts of an observation; a row with a null or nan part is a frame without
    observation, as is a frame without row. An empty table leaves the model as it is. The tracks are written once and read by every round.
    """
    ship(rows.sparkSession)
    d, o = len(model.mean), len(model.r)
    tracks = written(sequences(rows, list(keys), values, length).select("z"))
    path: list[float] = []
    for _ in range(rounds):
        now = model

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, some, cells = None, [], 0

            def add(total: np.ndarray | None) -> np.ndarray:
                got = expected(now, some).flat()
                return got if total is None else total + got

            for pdf in parts:
                for z in pdf.z:
                    own = np.asarray(z, float).reshape(-1, o)
                    if some and max(cells, len(own)) * (len(some) + 1) > CELLS:
                        total, some, cells = add(total), [], 0
                    some.append(own)
                    cells = max(cells, len(own))
            if some:
                total = add(total)
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

        sums = {r.i: r.x for r in tracks.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
        if not sums:
            break
        s = Statistics.of(np.array([sums[i] for i in range(len(sums))]), d, o)
        path.append(float(s.likelihood[0]))
        model = maximised(model, s, fixed)
    return model, path


def parameters(spark: SparkSession, model: Kalman) -> DataFrame:
    """A model as rows (name, i, j, value)."""
    rows = [(k, i, j, float(x)) for k in PARAMETERS for i, own in enumerate(np.atleast_2d(getattr(model, k))) for j, x in enumerate(own)]
    return spark.createDataFrame(rows, "name string, i int, j int, value double")
