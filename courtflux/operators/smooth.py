"""Smoothing of court positions: outliers, chunks, Kalman filter and smoother."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..runtime import ship
from .relops import islands, lagged

KEYS = ["video_id", "player_id"]


def chunks(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Numbers the parts of each trajectory that no gap over ``max_gap_frames`` splits."""
    near = F.col("frame_id") - lagged("frame_id", KEYS, "frame_id") <= cfg.max_gap_frames
    return islands(rows, KEYS, "frame_id", near, "chunk")


def dense_chunks(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Chunks with a row for every frame; frames without a position have nulls."""
    part = chunks(rows, cfg)
    ends = part.groupBy(*KEYS, "chunk").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b"))
    frames = ends.select(*KEYS, "chunk", F.explode(F.sequence("a", "b")).alias("frame_id"))
    return frames.join(part, [*KEYS, "chunk", "frame_id"], "left")


def clean_outliers(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Positions become null where the box's bottom is over ``outlier_px`` from its rolling median (of rows, not frames)."""
    w = Window.partitionBy(*KEYS).orderBy("frame_id").rowsBetween(-cfg.median_radius, cfg.median_radius)
    near = F.array_sort(F.collect_list("y2").over(w))  # at most 2 * median_radius + 1 rows
    low, high = F.floor((F.size(near) - 1) / 2).cast("int"), F.floor(F.size(near) / 2).cast("int")
    far = F.abs(F.col("y2") - (F.get(near, low) + F.get(near, high)) / 2) > cfg.outlier_px
    ok = F.coalesce(~F.col("__far"), F.lit(True))
    return rows.withColumn("__far", far).withColumn("court_x", F.when(ok, F.col("court_x"))).withColumn("court_y", F.when(ok, F.col("court_y"))).drop("__far")


class Kalman:
    """A linear-Gaussian model: state' = A state + N(0, Q), seen = H state + N(0, R)."""

    def __init__(self, a: np.ndarray, h: np.ndarray, q: np.ndarray, r: np.ndarray, mean: np.ndarray, cov: np.ndarray):
        self.a, self.h, self.q, self.r, self.mean, self.cov = a, h, q, r, mean, cov

    def filter(self, seen: np.ndarray, there: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Filtered means and covariances and their predictions; a missing observation is replaced by its prediction, so it still narrows the covariance."""
        m, p, out = self.mean, self.cov, []
        eye = np.eye(len(m))
        for t in range(len(seen)):
            m0, p0 = self.a @ m, self.a @ p @ self.a.T + self.q
            z = seen[t] if there is None or there[t] else self.h @ m0
            gain = p0 @ self.h.T @ np.linalg.inv(self.h @ p0 @ self.h.T + self.r)
            m, p = m0 + gain @ (z - self.h @ m0), (eye - gain @ self.h) @ p0
            out.append((m, p, m0, p0))
        return tuple(np.array(x) for x in zip(*out))

    def smooth(self, m: np.ndarray, p: np.ndarray, m0: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rauch-Tung-Striebel means, covariances and gains."""
        s, v = m.copy(), p.copy()
        gains = np.zeros_like(p)
        for t in range(len(m) - 2, -1, -1):
            gains[t] = p[t] @ self.a.T @ np.linalg.inv(p0[t + 1])
            s[t] += gains[t] @ (s[t + 1] - m0[t + 1])
            v[t] += gains[t] @ (v[t + 1] - p0[t + 1]) @ gains[t].T
        return s, v, gains

    def fit(self, seen: np.ndarray, steps: int = 10) -> Kalman:
        """Expectation-maximisation of all parameters."""
        k = self
        for _ in range(steps):
            m, p, m0, p0 = k.filter(seen)
            s, v, g = k.smooth(m, p, m0, p0)
            n = len(seen)
            cross = np.array([v[t] @ g[t - 1].T + np.outer(s[t], s[t - 1]) for t in range(1, n)]).sum(0)
            second = np.array([v[t] + np.outer(s[t], s[t]) for t in range(n)])
            a = cross @ np.linalg.inv(second[:-1].sum(0))
            h = np.einsum("ti,tj->ij", seen, s) @ np.linalg.inv(second.sum(0))
            q = (second[1:].sum(0) - a @ cross.T) / (n - 1)
            r = (np.einsum("ti,tj->ij", seen, seen) - h @ np.einsum("ti,tj->ij", s, seen)) / n
            k = Kalman(a, h, (q + q.T) / 2, (r + r.T) / 2, s[0], v[0])
        return k


def generate(model: Kalman, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """States and observations drawn from a model."""
    rng = np.random.default_rng(seed)
    state, states, seen = rng.multivariate_normal(model.mean, model.cov), [], []
    for _ in range(n):
        state = model.a @ state + rng.multivariate_normal(np.zeros(len(state)), model.q)
        states.append(state)
        seen.append(model.h @ state + rng.multivariate_normal(np.zeros(len(model.r)), model.r))
    return np.array(states), np.array(seen)


def position_model(first: np.ndarray, second: np.ndarray | None, obs: float = 0.1, pos: float = 0.01, vel: float = 0.1) -> Kalman:
    """Constant velocity in two dimensions, begun at the first observations."""
    a = np.eye(4)
    a[0, 2] = a[1, 3] = 1
    v = second - first if second is not None else np.zeros(2)
    return Kalman(a, np.eye(2, 4), np.diag([pos, pos, vel, vel]), obs * np.eye(2), np.concatenate([first, v]), np.diag([0.1, 0.1, 0.5, 0.5]))


def smoothed_chunk(xy: np.ndarray, least: int = 4) -> np.ndarray:
    """Smoothed positions of a dense chunk (nan: not seen); under ``least`` observations stay as they are."""
    there = ~np.isnan(xy[:, 0])
    if there.sum() < least:
        return xy
    seen = xy[there]
    k = position_model(seen[0], seen[1])
    return k.smooth(*k.filter(np.where(there[:, None], xy, 0.0), there))[0][:, :2]


def smoothed_chunks(chunks: list[np.ndarray], least: int = 4) -> list[np.ndarray]:
    """``smoothed_chunk`` of many chunks at once.

    Covariances, and so gains, depend on neither observations nor gaps: they are found once for the longest chunk, and each step then
    moves the means of all chunks.
    """
    out = list(chunks)
    some = [i for i, xy in enumerate(chunks) if (~np.isnan(xy[:, 0])).sum() >= least]
    if not some:
        return out
    size = np.array([len(chunks[i]) for i in some])
    seen = np.full((len(some), size.max(), 2), np.nan)
    first = np.empty((len(some), 2, 2))
    for k, i in enumerate(some):
        seen[k, : size[k]] = chunks[i]
        first[k] = chunks[i][~np.isnan(chunks[i][:, 0])][:2]
    model = position_model(first[0, 0], first[0, 1])
    p, gains, back, before = model.cov, [], [], None
    eye = np.eye(4)
    for _ in range(size.max()):
        p0 = model.a @ p @ model.a.T + model.q
        if before is not None:
            back.append(before @ model.a.T @ np.linalg.inv(p0))
        gain = p0 @ model.h.T @ np.linalg.inv(model.h @ p0 @ model.h.T + model.r)
        p = before = (eye - gain @ model.h) @ p0
        gains.append(gain)
    m = np.concatenate([first[:, 0], first[:, 1] - first[:, 0]], 1)
    means, ahead = np.empty((size.max(), len(some), 4)), np.empty((size.max(), len(some), 4))
    for t, gain in enumerate(gains):
        ahead[t] = m @ model.a.T
        step = np.nan_to_num(seen[:, t] - ahead[t, :, :2])  # no step without an observation
        m = means[t] = ahead[t] + step @ gain.T
    for t in range(size.max() - 2, -1, -1):
        inside = t < size - 1
        means[t, inside] += (means[t + 1, inside] - ahead[t + 1, inside]) @ back[t].T
    for k, i in enumerate(some):
        out[i] = means[: size[k], k, :2]
    return out


def smooth_positions(rows: DataFrame, cfg: Config = DEFAULT, compat: bool = False) -> DataFrame:
    """Rows (video_id, player_id, frame_id, y2, court_x, court_y) with smoothed positions where there is one.

    Untracked rows (player_id -1) are left alone; ``compat`` smooths them as one pseudo-player, the last row of a frame standing for it.
    A video is one task's group, and all its chunks are smoothed together.
    """
    ship(rows.sparkSession)
    some = rows if compat else rows.where("player_id <> -1")
    one = some.groupBy(*KEYS, "frame_id").agg(F.max_by(F.struct("y2", "court_x", "court_y"), "det_idx").alias("x")).select(*KEYS, "frame_id", "x.*")
    dense = dense_chunks(clean_outliers(one, cfg), cfg)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["player_id", "chunk", "frame_id"])
        xy, key = pdf[["court_x", "court_y"]].to_numpy(float), pdf[["player_id", "chunk"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        xy = np.concatenate(smoothed_chunks(np.split(xy, cuts)))
        return pdf[["video_id", "player_id", "frame_id"]].assign(sx=xy[:, 0], sy=xy[:, 1])

    got = dense.groupBy("video_id").applyInPandas(run, "video_id long, player_id long, frame_id long, sx double, sy double").where("sx is not null and not isnan(sx)")
    joined = rows.join(got, [*KEYS, "frame_id"], "left")
    return joined.withColumn("court_x", F.coalesce("sx", "court_x")).withColumn("court_y", F.coalesce("sy", "court_y")).drop("sx", "sy")


def trails(rows: DataFrame, length: int = 30) -> DataFrame:
    """The last ``length`` positions of each player up to each row."""
    w = Window.partitionBy(*KEYS).orderBy("frame_id").rowsBetween(-(length - 1), 0)
    return rows.withColumn("trail", F.collect_list(F.struct("court_x", "court_y")).over(w))


def fill_both_ways(df: DataFrame, value: str, key: str = "video_id", order: str = "frame_id") -> DataFrame:
    """Nulls take the last value before, those at the start the first after."""
    w = Window.partitionBy(key).orderBy(order)
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(last, first))


def track_segments(rows: DataFrame, length: int) -> DataFrame:
    """Numbers each track's stretches of ``length`` frames from its first frame on."""
    first = F.min("frame_id").over(Window.partitionBy(*KEYS))
    return rows.withColumn("segment", F.floor((F.col("frame_id") - first) / length))


def seeded(keys: list[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the keys and a seed only: for random choices that a lost task repeats."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)


def padded_clips(frames: DataFrame, start: Column, length: int, slots: int, dropped: Column | None = None) -> DataFrame:
    """A clip of each video for training: ``length`` frames from ``start`` on, less those that ``dropped`` says, as ``slots`` slots.

    A slot without a frame has nulls and is not ``there``. ``start`` and ``dropped`` may draw by ``seeded``.
    """
    own = frames.withColumn("slot", F.col("frame_id") - start).where(F.col("slot").between(0, length - 1))
    videos = own.select("video_id").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    kept = own if dropped is None else own.where(~dropped)
    return videos.join(kept.withColumn("there", F.lit(True)), ["video_id", "slot"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def identity_batch(images: DataFrame, identities: int, each: int, seed: int) -> DataFrame:
    """A batch of P identities with K images each (rows pid, path): both drawn by hashes; identities with fewer images are left out."""
    from .relops import top_k

    enough = images.groupBy("pid").agg(F.count("*").alias("__n")).where(F.col("__n") >= each).select("pid")
    chosen = enough.orderBy(seeded(["pid"], seed), "pid").limit(identities)
    return top_k(images.join(F.broadcast(chosen), "pid", "left_semi"), ["pid"], [seeded(["path"], seed + 1), F.col("path")], each)
