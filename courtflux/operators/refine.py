"""Homographies of a video refined together: near their own points, and steady under the camera's motion.

What is raised is, over all frames, the points' rewards ``exp((cos - 1) / eps)``, cos between a projected point and its mark as directions,
less ``cost`` times the distance of each frame's homography from the one before carried along (probe vectors turned both ways, as in
``court.distance``). A reward is at least its tangent in cos, and 1 - cos is half the squared distance of unit vectors, so each step is a
weighted Gauss-Newton step whose normal equations are block-tridiagonal; damping makes sure that no step lowers the sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, written
from .chains import _matrices
from .detect import FRAME
from .relops import paired
from .smooth import fill_both_ways

#: Probe vectors in the picture and on the court.
PICTURE, COURT = (np.array([(x, y, 1.0) for x in t for y in t]) for t in ((0, 0.5, 1), (-0.5, 0, 0.5)))


@dataclass(frozen=True)
class Goal:
    cost: float = 200.0
    eps: float = 0.003


@dataclass
class Chain:
    """Homographies' data: points (src -> dst, as directions) of frame numbers ``of``; ``back``: the map from frame t + 1 to t, where ``on``."""

    src: np.ndarray
    dst: np.ndarray
    of: np.ndarray
    back: np.ndarray
    on: np.ndarray


def _unit(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and how they change with the vectors."""
    size = np.maximum(np.linalg.norm(y, axis=-1, keepdims=True), 1e-12)
    u = y / size
    return u, (np.eye(3) - u[..., :, None] * u[..., None, :]) / size[..., None]


def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverses of matrices of 3 x 3; pseudo-inverses of those that are singular or close to it."""
    a, b, c = (m[..., i, :] for i in range(3))
    columns = [x[..., (1, 2, 0)] * y[..., (2, 0, 1)] - x[..., (2, 0, 1)] * y[..., (1, 2, 0)] for x, y in ((b, c), (c, a), (a, b))]
    det = (a * columns[0]).sum(-1)
    sound = np.abs(det) > 1e-9 * (m * m).sum((-2, -1)) ** 1.5
    out = np.stack(columns, -1) / np.where(sound, det, 1.0)[..., None, None]
    if not sound.all():
        out[~sound] = np.linalg.pinv(m[~sound])
    return out


@dataclass
class Turns:
    """Probes turned between frame t + 1 and frame t carried along, in four ways.

    ``u``: turned probes as unit vectors, ``size``: their lengths before. A change d of a frame's matrix changes a turned probe by left @ d @ right,
    right being a vector of each probe; ``of_after`` has both factors for frame t + 1, ``of_before`` for frame t.
    """

    u: np.ndarray
    size: np.ndarray
    of_after: tuple[np.ndarray, np.ndarray]
    of_before: tuple[np.ndarray, np.ndarray]


_PROBES = np.stack([PICTURE, PICTURE, COURT, COURT])
_ENDS = _PROBES / np.linalg.norm(_PROBES, axis=-1, keepdims=True)


def _turns(h: np.ndarray, c: Chain) -> Turns:
    a, p = h[1:], h[:-1] @ c.back
    ia, ip = _inverse(np.stack([a, p]))
    iap, ipa, pia, aip = ia @ p, ip @ a, p @ ia, a @ ip
    on = lambda m: _PROBES @ np.swapaxes(m, -1, -2)
    eye = np.broadcast_to(np.eye(3), a.shape)
    turned = on(np.stack([iap, ipa, pia, aip], 1))
    size = np.maximum(np.sqrt((turned * turned).sum(-1, keepdims=True)), 1e-12)
    after = np.stack([-ia, ip, -pia, eye], 1), on(np.stack([iap, eye, ia, ip], 1))
    before = np.stack([ia, -ip, eye, -aip], 1), on(c.back[:, None] @ np.stack([eye, ipa, ia, ip], 1))
    return Turns(turned / size, size, after, before)


def objective(h: np.ndarray, c: Chain, goal: Goal) -> float:
    return float(_objectives(h, c, goal, np.zeros(len(h), int), 1)[0])


def _objectives(h: np.ndarray, c: Chain, goal: Goal, chain: np.ndarray, chains: int) -> np.ndarray:
    """The objective of each chain; ``chain``: the frames' chains by number."""
    turns = _turns(h, c)
    u, e = _unit((h[c.of] @ c.src[:, :, None])[..., 0])[0], _unit(c.dst)[0]
    total = np.bincount(chain[c.of], np.exp(((u * e).sum(-1) - 1) / goal.eps), chains)
    cos = (turns.u * _ENDS).sum(-1)
    return total - goal.cost * np.bincount(chain[1:], (1 - cos).sum((1, 2)) * c.on, chains)


def _products(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Per frame the sum over its vectors of the Kronecker products of (3, 3) ``inner`` and ``outer``; (frames, vectors, 3, 3) each."""
    n, v = inner.shape[:2]
    both = np.swapaxes(inner.reshape(n, v, 9), 1, 2) @ outer.reshape(n, v, 9)
    return both.reshape(n, 3, 3, 3, 3).transpose(0, 1, 3, 2, 4).reshape(n, 9, 9)


def normal_equations(h: np.ndarray, c: Chain, goal: Goal) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal blocks, blocks between frames t and t + 1, and the downward gradient, of nine numbers a frame.

    A turned probe changes by left @ d @ right, less what is along it: sums of products of slopes are Kronecker products of (3, 3), less those along.
    """
    n, turns = len(h), _turns(h, c)
    diagonal, slope = np.zeros((n, 9, 9)), np.zeros((n, 9))
    u, change = _unit((h[c.of] @ c.src[:, :, None])[..., 0])
    e = _unit(c.dst)[0]
    w = np.exp(((u * e).sum(-1) - 1) / goal.eps) / goal.eps
    inner, outer = w[:, None, None] * (change @ change), c.src[:, :, None] * c.src[:, None, :]
    np.add.at(diagonal, c.of, (inner[:, :, None, :, None] * outer[:, None, :, None, :]).reshape(-1, 9, 9))
    down = w[:, None] * (change @ (u - e)[:, :, None])[..., 0]
    np.add.at(slope, c.of, (down[:, :, None] * c.src[:, None, :]).reshape(-1, 9))

    scale = np.sqrt(goal.cost) * c.on[:, None, None, None] / turns.size
    off = (turns.u - _ENDS) * np.sqrt(goal.cost)
    ahead = (turns.u * off).sum(-1, keepdims=True)
    lefts, rights, alongs, slopes = [], [], [], []
    for left, right in (turns.of_after, turns.of_before):
        along, right = turns.u @ left, right * scale
        lefts.append(left)
        rights.append(right)
        alongs.append((along[..., :, None] * right[..., None, :]).reshape(n - 1, 4 * len(PICTURE), 9))
        slopes.append((np.swapaxes(off @ left - along * ahead, -1, -2) @ right).sum(1).reshape(n - 1, 9))

    def products(i: int, j: int) -> np.ndarray:
        whole = _products(np.swapaxes(lefts[i], -1, -2) @ lefts[j], np.swapaxes(rights[i], -1, -2) @ rights[j])
        return whole - np.swapaxes(alongs[i], 1, 2) @ alongs[j]

    diagonal[1:] += products(0, 0)
    diagonal[:-1] += products(1, 1)
    slope[1:] += slopes[0]
    slope[:-1] += slopes[1]
    return diagonal, products(1, 0), slope


def block_solve(diagonal: np.ndarray, beside: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric block-tridiagonal system: every second block is eliminated, all of them at once, until one is left."""
    n = len(diagonal)
    if n == 1:
        return np.linalg.solve(diagonal, right[..., None])[..., 0]
    size, before, after = diagonal.shape[1], beside[::2], beside[1::2]
    m, k = len(after), n // 2  # blocks with a block behind them, among those that go
    ahead = np.concatenate([after, np.zeros((k - m, size, size))])
    both = np.linalg.solve(diagonal[1::2], np.concatenate([np.swapaxes(before, 1, 2), ahead, right[1::2, :, None]], 2))
    p, q, s = both[..., :size], both[:m, :, size:-1], both[..., -1:]
    d, r = diagonal[::2].copy(), right[::2, :, None].copy()
    back = np.swapaxes(after, 1, 2)
    d[:k] -= before @ p
    r[:k] -= before @ s
    d[1 : m + 1] -= back @ q
    r[1 : m + 1] -= back @ s[:m]
    x = np.empty_like(right)
    x[::2] = kept = block_solve(d, -before[:m] @ q, r[..., 0])
    gone = s - p @ kept[:k, :, None]
    gone[:m] -= q @ kept[1 : m + 1, :, None]
    x[1::2] = gone[..., 0]
    return x


def _part(c: Chain, at: np.ndarray, frames: int) -> Chain:
    """The chain of the frames ``at``, of which none is tied to a frame that is left out."""
    place = np.full(frames, -1)
    place[at] = np.arange(len(at))
    own = place[c.of] >= 0
    return Chain(c.src[own], c.dst[own], place[c.of[own]], c.back[at[:-1]], c.on[at[:-1]])


def refined(h: np.ndarray, c: Chain, fixed: np.ndarray, goal: Goal = Goal(), steps: int = 10, begins: np.ndarray | None = None) -> np.ndarray:
    """Homographies of unit size after up to ``steps`` steps; those that are ``fixed`` stay. The objective never falls.

    ``begins``: the frames at which chains begin that aren't tied to the frame before (at least the first). Each has a damping and an end of its
    own, and its steps are those that it would take alone; only the arrays are made for all.
    """
    n, free = len(h), ~fixed
    h = h / np.sqrt((h * h).sum((1, 2), keepdims=True))
    begins = np.zeros(1, int) if begins is None else begins
    k = len(begins)
    chain = np.repeat(np.arange(k), np.diff(np.append(begins, n)))
    now, damping, going = _objectives(h, c, goal, chain, k), np.full(k, 1e-3), np.ones(k, bool)
    for _ in range(steps):
        at = np.flatnonzero(going[chain])
        if not len(at):
            break
        diagonal, beside, slope = normal_equations(h[at], _part(c, at, n), goal)
        loose = free[at]
        diagonal, slope = diagonal * loose[:, None, None], slope * loose[:, None]
        beside = beside * (loose[1:] & loose[:-1])[:, None, None]
        size = np.bincount(chain[at], np.einsum("tii->t", diagonal), k) / np.maximum(np.bincount(chain[at], minlength=k), 1) / 9
        size, gain, tried = np.maximum(size, 1e-12), np.zeros(k), going.copy()
        for _ in range(12):
            own = np.flatnonzero(tried[chain[at]])
            if not len(own):
                break
            those = at[own]
            extra = np.where(free[those], (damping * size)[chain[those]], 1.0)[:, None, None] * np.eye(9)
            moved = h[those] - block_solve(diagonal[own] + extra, beside[own[:-1]], slope[own]).reshape(-1, 3, 3)
            moved /= np.sqrt((moved * moved).sum((1, 2), keepdims=True))
            then = _objectives(moved, _part(c, those, n), goal, chain[those], k)
            good = tried & (then >= now)
            kept = good[chain[those]]
            h[those[kept]] = moved[kept]
            gain[good], now[good] = (then - now)[good], then[good]
            damping[good] = np.maximum(damping[good] / 6, 1e-9)
            tried &= ~good
            damping[tried] *= 6
        going &= ~tried & (gain > 1e-10 * (1 + np.abs(now - gain)))
    return h


#: Frames and points whose arrays are made at once (or one block's), and frames that a grouped map gets on average.
FRAMES, POINTS = 1024, 16384


def _many(f: pd.DataFrame, p: pd.DataFrame, goal: Goal, steps: int) -> pd.DataFrame:
    """Refined homographies of the blocks' own frames; rows of many blocks (video_id, blk)."""
    if not len(f):
        return f[FRAME].assign(h=pd.Series([], dtype=object))
    f = f.sort_values(["video_id", "blk", "frame_id"], kind="stable").reset_index(drop=True)
    places = f[["video_id", "blk", "frame_id"]].drop_duplicates().reset_index(names="at")
    p = p.merge(places, on=["video_id", "blk", "frame_id"]).sort_values(["at", "rank"], kind="stable")
    src, dst, of = np.c_[p[["sx", "sy"]].to_numpy(float), np.ones(len(p))], np.c_[p[["dx", "dy"]].to_numpy(float), np.ones(len(p))], p["at"].to_numpy(int)
    h, first, m = _matrices(f.h), f["first"].to_numpy(bool), _matrices(f.step)[1:]
    begun = (f[["video_id", "blk"]] != f[["video_id", "blk"]].shift()).any(axis=1).to_numpy()
    on = f.step.notna().to_numpy()[1:] & (np.diff(f.frame_id) == 1) & ~begun[1:]
    back = np.where(on[:, None, None], _inverse(np.nan_to_num(m)), np.eye(3))
    begins = np.flatnonzero(begun)
    ends = np.append(begins[1:], len(f))
    behind, out, i = np.searchsorted(of, ends), np.empty_like(h), 0
    while i < len(begins):
        a, q = begins[i], np.searchsorted(of, begins[i])
        j = max(i + 1, min(np.searchsorted(ends, a + FRAMES, "right"), np.searchsorted(behind, q + POINTS, "right")))
        b, r = ends[j - 1], behind[j - 1]
        part = Chain(src[q:r], dst[q:r], of[q:r] - a, back[a : b - 1], on[a : b - 1])
        out[a:b] = refined(h[a:b], part, first[a:b], goal, steps, begins[i:j] - a)
        i = j
    return f[FRAME].assign(h=[x.ravel().tolist() for x in out])[f.own.to_numpy(bool)]


def refine(frames: DataFrame, points: DataFrame, goal: Goal = Goal(), rounds: int = 6, block: int = 256, steps: int = 10) -> DataFrame:
    """video_id, frame_id, h and reward: homographies refined over their video, with the sum of their points' rewards.

    ``frames``: a row a frame with its first homography h (null: the last before, else the first after) and the map ``step`` from the frame
    before (null: the two frames are not tied, nor are frames with a gap between them); ``points``: (sx, sy) -> (dx, dy), null ones left out.
    A round works on blocks of frames side by side. A block's first frame stays, as does the next block's, which it sees; so blocks don't
    disturb each other, and no round lowers the whole sum. Every second round's blocks begin half a block later; what is wrong
    over many blocks alike takes more rounds to go. Blocks are dealt out to groups of some ``FRAMES`` frames by hash, so that a call works on many. A video without any
    homography keeps nulls and rewards of 0; an empty table gives an empty one. Matrices have 1 as last number, if it isn't 0.
    """
    ship(frames.sparkSession)
    keep = frames.select(*FRAME, "step")
    h = written(fill_both_ways(frames.select(*FRAME, "h", "step"), "h"))
    rank = F.xxhash64("frame_id", "sx", "sy", "dx", "dy").alias("rank")
    pts = written(points.where("sx + sy + dx + dy IS NOT NULL").select(*FRAME, "sx", "sy", "dx", "dy", rank))
    rows, tasks = h.count(), int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = F.lit(max(-(-rows // FRAMES), min(4 * tasks, -(-rows // block)), 1))
    group = F.pmod(F.xxhash64("video_id", "blk"), groups).alias("grp")
    for r in range(rounds):
        shift = r % 2 * (block // 2)
        at, first = F.floor((F.col("frame_id") + shift) / block), F.pmod(F.col("frame_id") + shift, F.lit(block)) == 0
        blocks = F.when(first, F.array(at, at - 1)).otherwise(F.array(at))
        seen = h.where("h IS NOT NULL").select("*", first.alias("first"), F.explode(blocks).alias("blk")).select("*", (F.col("blk") == at).alias("own"), group)
        new = paired(seen, pts.withColumn("blk", at).select("*", group), "grp", lambda f, p: _many(f, p, goal, steps), "video_id long, frame_id long, h array<double>")
        h = written(keep.join(new, FRAME, "left").select(*FRAME, "h", "step"))
    own = pts.join(h, FRAME).select(*FRAME, reward(F.col("h"), goal.eps).alias("r")).groupBy(*FRAME).agg(F.sum("r").alias("reward"))
    last = F.element_at("h", -1)
    unit = F.when(last != 0, F.transform("h", lambda x: x / last)).otherwise(F.col("h"))
    return h.join(own, FRAME, "left").select(*FRAME, unit.alias("h"), F.coalesce("reward", F.lit(0.0)).alias("reward"))


def reward(h: Column, eps: float) -> Column:
    """The reward of a point (sx, sy) -> (dx, dy) under a homography."""
    y = [F.get(h, F.lit(3 * i)) * F.col("sx") + F.get(h, F.lit(3 * i + 1)) * F.col("sy") + F.get(h, F.lit(3 * i + 2)) for i in range(3)]
    d = [F.col("dx"), F.col("dy"), F.lit(1.0)]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.exp((dot(y, d) / F.sqrt(dot(y, y) * dot(d, d)) - 1) / eps)
