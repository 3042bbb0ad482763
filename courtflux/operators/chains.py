"""Chains of frame-to-frame maps as scans over ordered blocks, a video's reference frame, and homographies refitted over pooled segments.

A chain is the product of a video's maps from its first frame on. Products are associative: each block of frames is multiplied by itself, the
blocks' products are scanned by the same rule, and a join applies what stands before a block. No group holds a whole video.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..runtime import ship, written
from .court import drawn_fours, from_four
from .detect import FRAME
from .relops import paired

#: Frames of a block that one call multiplies; also blocks of a block of blocks.
BLOCK = 64
_MATRIX = "array<double>"


def product(a: Column, b: Column) -> Column:
    """The product of two 3x3 matrices (arrays of nine numbers); null if one is."""
    cell = [sum((F.get(a, F.lit(3 * i + k)) * F.get(b, F.lit(3 * k + j)) for k in range(1, 3)), F.get(a, F.lit(3 * i)) * F.get(b, F.lit(j))) for i in range(3) for j in range(3)]
    return F.when(a.isNotNull() & b.isNotNull(), F.array(*cell))


def identity() -> Column:
    return F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))


def _block(left: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a block's maps m: what stands before each row and up to it (a null map makes all that follows null), and the whole on the first row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        now: np.ndarray | None = np.eye(3)
        before, upto = [], []
        for m in pdf.m:
            before.append(now)
            step = None if m is None or now is None else np.asarray(m, float).reshape(3, 3)
            now = None if step is None else step @ now if left else now @ step
            upto.append(now)
        flat = lambda ms: [None if m is None else m.ravel().tolist() for m in ms]
        first = np.arange(len(pdf)) == 0
        return pd.DataFrame({"video_id": pdf.video_id.to_numpy(), "at": pdf["at"].to_numpy(), "blk": pdf.blk.to_numpy(), "first": first, "before": flat(before), "upto": flat(upto), "whole": flat([now if x else None for x in first])})

    return run


def scan(rows: DataFrame, left: bool, block: int) -> DataFrame:
    """video_id, at, and the products ``before`` and ``upto`` of rows (video_id, at, m) in the order of ``at``."""
    ship(rows.sparkSession)
    schema = f"video_id long, at long, blk long, first boolean, before {_MATRIX}, upto {_MATRIX}, whole {_MATRIX}"
    own = written(rows.withColumn("blk", F.floor(F.col("at") / block)).groupBy("video_id", "blk").applyInPandas(_block(left), schema))
    blocks = own.where("first").select("video_id", F.col("blk").alias("at"), F.col("whole").alias("m"))
    most = blocks.groupBy("video_id").count().agg(F.max("count")).first()[0]
    if (most or 0) <= 1:
        return own.select("video_id", "at", "before", "upto")
    lead = scan(blocks, left, block).select("video_id", F.col("at").alias("blk"), F.col("before").alias("lead"))
    join = lambda m: product(F.col(m), F.col("lead")) if left else product(F.col("lead"), F.col(m))
    return own.join(lead, ["video_id", "blk"]).select("video_id", "at", join("before").alias("before"), join("upto").alias("upto"))


def chains(frames: DataFrame, carry: bool = True, left: bool = True, block: int = BLOCK) -> DataFrame:
    """video_id, frame_id and m, the product of the maps ``step`` from a video's first frame to each; the first frame's own step doesn't count.

    A missing step carries the product before (``carry``), or ends the chain: it is null from there on. ``left``: each step is multiplied
    from the left, else from the right.
    """
    first = frames.groupBy("video_id").agg(F.min("frame_id").alias("__first"))
    step = F.when(F.col("frame_id") == F.col("__first"), identity()).otherwise(F.coalesce("step", identity()) if carry else F.col("step"))
    rows = frames.join(first, "video_id").select("video_id", F.col("frame_id").alias("at"), step.alias("m"))
    return scan(rows, left, block).select("video_id", F.col("at").alias("frame_id"), F.col("upto").alias("m"))


def to_reference(chain: DataFrame, references: DataFrame, left: bool = True) -> DataFrame:
    """``chain`` with m as the product from each video's reference frame (column ref) on; null where its inverse doesn't exist."""
    at = chain.join(references.select("video_id", "ref"), "video_id").where("frame_id = ref").select("video_id", G.inverse(F.col("m")).alias("__inv"))
    m = product(F.col("m"), F.col("__inv")) if left else product(F.col("__inv"), F.col("m"))
    return chain.join(at, "video_id").select("video_id", "frame_id", m.alias("m"))


# -- the reference frame -------------------------------------------------------------------------------------------------------


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the points' convex hull; all points on its edge may be left out."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for x in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]):
                out.pop()
            out.append(x)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hulls(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """video_id and corners (x, y) of the hull of each video's points (video_id, at, x, y): hulls of blocks, then of their corners by blocks."""
    ship(points.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"video_id": pdf.video_id.iloc[0], "at": pdf.blk.iloc[0], "x": h[:, 0], "y": h[:, 1]})

    while True:
        rows = points.withColumn("blk", F.floor(F.col("at") / block)).groupBy("video_id", "blk").applyInPandas(run, "video_id long, at long, x double, y double")
        points = written(rows)
        if points.agg(F.max("at") - F.min("at")).first()[0] in (None, 0):
            return points.groupBy("video_id").agg(F.collect_list(F.struct("x", "y")).alias("corners"))


def _moved(m: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    at = lambda i: F.get(m, F.lit(i))
    return tuple(at(3 * i) * x + at(3 * i + 1) * y + at(3 * i + 2) for i in range(3))


def reference_frames(frames: DataFrame, width: float, height: float, block: int = BLOCK) -> DataFrame:
    """video_id, ref and farthest: the frame onto which the centres of all frames fall nearest to its own, by the farthest of them.

    Frames behind a missing step have no part in it. Seen from a frame the farthest centre is a corner of the hull of all centres, unless
    the frame's horizon cuts the hull; only for such frames all centres are looked at, block by block. Equally near ones: the smallest.
    """
    cx, cy = F.lit(width / 2), F.lit(height / 2)
    own = written(chains(frames, carry=False, left=False, block=block).where("m is not null"))
    x, y, w = _moved(F.col("inv"), cx, cy)
    back = written(own.select("video_id", "frame_id", G.inverse(F.col("m")).alias("inv")).where("inv is not null"))
    centres = back.select("video_id", F.col("frame_id").alias("at"), x.alias("x"), y.alias("y"), w.alias("w"))
    near = written(centres.where("w <> 0").select("video_id", "at", (F.col("x") / F.col("w")).alias("x"), (F.col("y") / F.col("w")).alias("y"), F.lit(1.0).alias("w")).unionByName(centres.where("w = 0")))
    endless = near.where("w = 0").select("video_id").distinct().withColumn("endless", F.lit(True))

    def far(points: Column) -> Column:
        """The farthest point's distance from the centre, and the least and largest third component."""

        def each(p: Column) -> Column:
            m = F.col("m")
            at = lambda i: F.get(m, F.lit(i))
            q = [at(3 * i) * p["x"] + at(3 * i + 1) * p["y"] + at(3 * i + 2) * p["w"] for i in range(3)]
            return F.struct(F.sqrt(F.pow(q[0] / q[2] - cx, 2) + F.pow(q[1] / q[2] - cy, 2)).alias("d"), q[2].alias("w"))

        t = F.transform(points, each)
        return F.struct(F.array_max(F.transform(t, lambda e: e["d"])).alias("d"), F.array_min(F.transform(t, lambda e: e["w"])).alias("lo"), F.array_max(F.transform(t, lambda e: e["w"])).alias("hi"))

    corners = hulls(near.where("w <> 0").drop("w"), block).join(endless, "video_id", "left")
    seen = own.join(corners, "video_id").withColumn("corners", F.transform("corners", lambda p: F.struct(p["x"], p["y"], F.lit(1.0).alias("w"))))
    seen = seen.select("video_id", "frame_id", "m", "endless", far(F.col("corners")).alias("f"))
    whole = F.col("endless").isNull() & ((F.col("f.lo") > 1e-12) | (F.col("f.hi") < -1e-12))
    seen = written(seen.withColumn("whole", whole))
    sure = seen.where("whole").select("video_id", "frame_id", F.col("f.d").alias("d"))
    rest = seen.where("not whole").select("video_id", "frame_id", "m")
    blocks = near.groupBy("video_id", F.floor(F.col("at") / block).alias("blk")).agg(F.collect_list(F.struct("x", "y", "w")).alias("points"))
    each = rest.join(blocks, "video_id").select("video_id", "frame_id", far(F.col("points"))["d"].alias("d")).groupBy("video_id", "frame_id").agg(F.max("d").alias("d"))
    return sure.unionByName(each).groupBy("video_id").agg(F.min_by("frame_id", F.struct("d", "frame_id")).alias("ref"), F.min("d").alias("farthest"))


# -- homographies of pooled segments -------------------------------------------------------------------------------------------

#: Points that hypotheses are drawn from in a segment (those with the lowest hashes), and how many are drawn.
SAMPLE, TRIES = 256, 1000
#: Frames of a block whose segments are refitted in one call; longer segments by rounds over blocks. A power of two.
FRAMES = 256


def _unit(p: np.ndarray) -> np.ndarray:
    return p / np.maximum(np.linalg.norm(p, axis=-1, keepdims=True), 1e-12)


def homogeneous(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p, np.ones((*p.shape[:-1], 1))], -1)


def hypotheses(src: np.ndarray, dst: np.ndarray, seed: tuple[int, ...], tries: int = TRIES) -> np.ndarray:
    """Homographies of fours of the points, of every four if these are no more than ``tries``."""
    pick = drawn_fours(len(src), tries, seed)
    return from_four(src[pick], dst[pick])


def votes(h: np.ndarray, src: np.ndarray, dst: np.ndarray, eps: float = 0.005) -> np.ndarray:
    """Of each hypothesis the soft agreement of directions over the points; points are taken in parts."""
    total, rows = np.zeros(len(h)), np.ascontiguousarray(h.reshape(-1, 9).T)
    part = max(1, (1 << 14) // max(len(h), 1))  # of points: arrays that stay in a processor's cache
    for at in range(0, len(src), part):
        a, b = homogeneous(src[at : at + part]), homogeneous(dst[at : at + part])
        x, y, w = a @ rows[:3], a @ rows[3:6], a @ rows[6:]  # by component: points beside hypotheses
        cos = x * b[:, :1]
        cos += y * b[:, 1:2]
        cos += w
        np.abs(cos, out=cos)
        x *= x  # from here on in place
        y *= y
        w *= w
        x += y
        x += w
        np.maximum(np.sqrt(x, out=x), 1e-12, out=x)
        x *= np.sqrt((b * b).sum(1, keepdims=True))
        cos /= x
        cos -= 1
        cos /= eps**2
        np.maximum(cos, -700, out=cos)  # about 1e-304; ``exp`` of less takes ten times as long
        total += np.exp(cos, out=cos).sum(0)
    return total


def most_voted(h: np.ndarray, src: np.ndarray, dst: np.ndarray, eps: float = 0.005) -> int:
    """The hypothesis with the most ``votes``, the first of equal ones.

    A point's vote is at most 1, so hypotheses that the points left can't bring up to the votes of a promising one are not counted to the end.
    """
    n, done = len(src), 3 * len(src) // 8
    left, total = np.arange(len(h)), votes(h, src[:done], dst[:done], eps)
    top = total.argmax()
    least = total[top] + votes(h[top : top + 1], src[done:], dst[done:], eps)[0]
    if n < 16 or not np.isfinite(total).all() or not np.isfinite(least):  # too few to save anything, or numbers that nothing compares with
        return int(votes(h, src, dst, eps).argmax())
    while True:
        some = total + (n - done) >= least - 1e-9 * n  # sums in another order differ by less
        left, total = left[some], total[some]
        if done == n:
            return int(left[total.argmax()])
        more = min(n, done + -(-n // 8))
        total = total + votes(h[left], src[done:more], dst[done:more], eps)
        done = more


def rewards(h: np.ndarray, src: np.ndarray, dst: np.ndarray, of: np.ndarray, n: int, eps: float) -> np.ndarray:
    """Each frame's sum over its points (``of`` tells whose) of how well its homography turns them; nan matrices earn nothing."""
    to = np.einsum("pij,pj->pi", h[of], homogeneous(src))
    cos = (_unit(to) * _unit(homogeneous(dst))).sum(-1)
    return np.bincount(of, np.nan_to_num(np.exp((cos - 1) / eps)), minlength=n)


_PICTURE = np.array([(x, y, 1.0) for x in (0, 0.5, 1) for y in (0, 0.5, 1)])
_COURT = np.array([(x, y, 1.0) for x in (-0.5, 0, 0.5) for y in (-0.5, 0, 0.5)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far pairs of homographies turn nine probes of the picture and nine of the court, both ways; 0 where one is missing."""
    out = np.zeros(len(a))
    some = np.flatnonzero(np.isfinite(a).all((1, 2)) & np.isfinite(b).all((1, 2)))
    if len(some):
        a, b = a[some], b[some]
        ia, ib = np.linalg.pinv(a), np.linalg.pinv(b)
        for probe, turns in ((_PICTURE, (ia @ b, ib @ a)), (_COURT, (b @ ia, a @ ib))):
            for t in turns:
                out[some] += (1 - (_unit(probe @ np.swapaxes(t, 1, 2)) * _unit(probe)).sum(-1)).sum(-1)
    return out


#: How sharp a point's reward is, and what a frame's jump from the one before costs.
@dataclass(frozen=True)
class Weights:
    eps: float = 0.003
    jump: float = 200.0


def refit_block(h: np.ndarray, chain: np.ndarray, step: np.ndarray, frame: np.ndarray, src: np.ndarray, dst: np.ndarray, of: np.ndarray, rank: np.ndarray, video: int, weights: Weights, most: int) -> np.ndarray:
    """The homographies of a block's frames after all segments of up to ``most`` frames, shorter first, took a pooled one where that scores more.

    ``h``: the frames' own (nan: none); ``chain``: first frame to each; ``step``: from the frame before (nan: none); ``of``: each point's row
    in ``frame``; ``rank``: the points' hashes. The pooled homographies follow the chain, so they have no jumps between them.
    """
    h, back, turned = h.copy(), np.linalg.pinv(chain), inverses(step)
    size = 2
    while size <= most:
        segment, at = np.unique(frame // size, return_inverse=True)
        cuts = np.searchsorted(at, np.arange(len(segment) + 1))
        ends = np.searchsorted(at[of], np.arange(len(segment) + 1))
        to = chain[cuts[at]] @ back  # from each frame to its segment's first
        carried, best, tried = moved(to[of], src), np.full((len(segment), 3, 3), np.nan), np.zeros(len(segment), bool)
        for k, s in enumerate(segment.tolist()):
            own = slice(ends[k], ends[k + 1])
            if cuts[k + 1] - cuts[k] < 2 or ends[k + 1] - ends[k] < 4:
                continue
            x, y = carried[own], dst[own]
            few = np.lexsort((of[own], rank[own]))[:SAMPLE]
            hyp = hypotheses(x[few], y[few], (video, s, size))
            best[k], tried[k] = hyp[most_voted(hyp, x, y)], True
        new = normal(best[at] @ to)
        gain = rewards(new, src, dst, of, len(h), weights.eps) - rewards(h, src, dst, of, len(h), weights.eps)
        jump = weights.jump * jumps(h, step, frame, inverse=turned)
        jump[cuts[:-1]] = 0  # those into a segment are not its own
        better = (tried & (np.bincount(at, gain + jump) > 0))[at]
        h[better] = new[better]
        size *= 2
    return h


def inverses(step: np.ndarray) -> np.ndarray:
    """The pseudo-inverses of matrices; nan where one is missing."""
    good, out = np.isfinite(step).all((1, 2)), np.full_like(step, np.nan)
    out[good] = np.linalg.pinv(step[good])
    return out


def jumps(h: np.ndarray, step: np.ndarray, frame: np.ndarray, before: np.ndarray | None = None, inverse: np.ndarray | None = None) -> np.ndarray:
    """How far each frame's homography is from what that of the frame before and the map between them say; 0 where one is missing.

    ``before``: the homographies of the frames before; else they are the rows above. ``inverse``: the steps' inverses, if they are known.
    """
    if before is None:
        before = np.concatenate([np.full((1, 3, 3), np.nan), h[:-1]])
        before[1:][frame[1:] != frame[:-1] + 1] = np.nan
    return distances(h, before @ (inverses(step) if inverse is None else inverse))


def moved(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.einsum("pij,pj->pi", m, homogeneous(p))
    return q[:, :2] / np.where(np.abs(q[:, 2:]) < 1e-12, 1e-12, q[:, 2:])


def normal(h: np.ndarray) -> np.ndarray:
    """Matrices with a last number of 1, where it isn't 0."""
    last = h[..., 2:3, 2:3]
    return h / np.where(np.abs(last) > 1e-12, last, 1)


def _matrices(column: pd.Series) -> np.ndarray:
    return np.array([np.full((3, 3), np.nan) if m is None else np.asarray(m, float).reshape(3, 3) for m in column]).reshape(-1, 3, 3)


def _block_arrays(f: pd.DataFrame, p: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames and points in order: the frames' rows, the points' places and marks, their rows' numbers and their hashes."""
    f = f.sort_values("frame_id", kind="stable")
    p = p[p.frame_id.isin(f.frame_id)].sort_values(["frame_id", "rank"], kind="stable")
    return f, p[["sx", "sy"]].to_numpy(float), p[["dx", "dy"]].to_numpy(float), np.searchsorted(f.frame_id.to_numpy(), p.frame_id.to_numpy()), p["rank"].to_numpy()


def replace_segments(frames: DataFrame, points: DataFrame, weights: Weights = Weights(), block: int = FRAMES) -> DataFrame:
    """video_id, frame_id and h: each frame's homography, or that of a segment of frames whose points are pooled, where this scores better.

    ``frames``: own homography h (null: none) and map ``step`` from the frame before (null: none, the chain goes on), frames without gaps;
    ``points``: (sx, sy) -> (dx, dy). A video's segments are the frames of one f div 2, then f div 4, and so on. Of each, all points are carried along
    the chain to its first frame and one homography is fitted to them (the best of ``TRIES`` fours of the ``SAMPLE`` points with the lowest
    hashes); carried back it replaces the segment's homographies if the points' rewards, less the jumps between frames, grow.

    Segments of up to ``block`` frames (a power of two) are one call's work on a block. For longer ones rounds over blocks add up votes and
    gains in Spark, so that no group holds more than a block. Frames without points, homographies or steps are as good as any; an empty
    table gives an empty one. Homographies that nothing replaces stay as they are.
    """
    ship(frames.sparkSession)
    chain = chains(frames.select(*FRAME, "step")).withColumnRenamed("m", "chain")
    group = F.concat_ws(":", "video_id", F.floor(F.col("frame_id") / block)).alias("grp")
    known = written(frames.select(*FRAME, "h", "step", group).join(chain, FRAME))
    rank = F.xxhash64("frame_id", "sx", "sy", "dx", "dy").alias("rank")
    pts = written(points.select(*FRAME, "sx", "sy", "dx", "dy", rank, group))

    def inside(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        f, src, dst, of, own = _block_arrays(f, p)
        if len(f):
            h = refit_block(_matrices(f.h), _matrices(f.chain), _matrices(f.step), f.frame_id.to_numpy(), src, dst, of, own, int(f.video_id.iloc[0]), weights, block)
            f = f.assign(h=[m.ravel().tolist() if np.isfinite(m).all() else None for m in h])
        return f[[*FRAME, "h"]]

    h = written(paired(known, pts, "grp", inside, f"video_id long, frame_id long, h {_MATRIX}"))
    last, size = frames.agg(F.max("frame_id")).first()[0], 2 * block
    while last is not None and size <= 2 * last:
        h = written(refit_round(known.drop("h"), h, pts, size, weights))
        size *= 2
    return h


def refit_round(known: DataFrame, h: DataFrame, pts: DataFrame, size: int, weights: Weights) -> DataFrame:
    """``h`` after the segments of ``size`` frames: each one's hypotheses, their votes and the best one's gain, added up over its blocks."""
    ship(h.sparkSession)
    seg, key = F.floor(F.col("frame_id") / size).alias("seg"), ["video_id", "seg"]
    starts = known.groupBy("video_id", seg).agg(F.min_by("chain", "frame_id").alias("start"), F.min("frame_id").alias("first"))
    rows = known.withColumn("seg", seg).join(starts, key)
    lowest = Window.partitionBy(*key).orderBy("rank", "frame_id")
    few = pts.withColumn("seg", seg).withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= SAMPLE)  # Spark limits each task's rows first

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        some = pdf.iloc[: int(len(pdf) >= 4)][key]
        if not len(some):
            return some.assign(hyp=[])
        carried = moved(_matrices(pdf.start) @ np.linalg.pinv(_matrices(pdf.chain)), pdf[["sx", "sy"]].to_numpy(float))
        drawn = hypotheses(carried, pdf[["dx", "dy"]].to_numpy(float), (*map(int, some.iloc[0]), size))
        return some.assign(hyp=[drawn.ravel().tolist()])

    drawn = few.drop("grp").join(rows.select(*FRAME, "chain", "start"), FRAME).groupBy(*key).applyInPandas(draw, "video_id long, seg long, hyp array<double>")
    drawn = written(drawn)
    heads = rows.groupBy("grp", *key).agg(F.min("frame_id").alias("frame_id")).join(drawn, key).select(*FRAME, "hyp")  # once a block

    def vote(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        f, src, dst, of, _ = _block_arrays(f, p)
        if not len(f) or f.hyp.iloc[0] is None:
            return pd.DataFrame({"video_id": [], "seg": [], "i": [], "v": []})
        to = _matrices(f.start) @ np.linalg.pinv(_matrices(f.chain))
        v = votes(np.asarray(f.hyp.iloc[0], float).reshape(-1, 3, 3), moved(to[of], src), dst)
        return pd.DataFrame({"video_id": f.video_id.iloc[0], "seg": f.seg.iloc[0], "i": np.arange(len(v)), "v": v})

    counted = paired(rows.join(heads, FRAME, "left"), pts, "grp", vote, "video_id long, seg long, i int, v double").groupBy(*key, "i").agg(F.sum("v").alias("v"))
    most = counted.groupBy(*key).agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("i"))
    best = written(most.join(drawn, key).select(*key, F.slice("hyp", F.col("i") * 9 + 1, F.lit(9)).alias("best")))
    before = h.select("video_id", (F.col("frame_id") + 1).alias("frame_id"), F.col("h").alias("h_before"))
    tried = rows.join(best, key).join(h, FRAME).join(before, FRAME, "left")

    def gain(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        f, src, dst, of, _ = _block_arrays(f, p)
        if not len(f):
            return pd.DataFrame({"video_id": [], "seg": [], "gain": []})
        old, frame, n = _matrices(f.h), f.frame_id.to_numpy(), len(f)
        new = normal(_matrices(f.best) @ _matrices(f.start) @ np.linalg.pinv(_matrices(f.chain)))
        got = rewards(new, src, dst, of, n, weights.eps).sum() - rewards(old, src, dst, of, n, weights.eps).sum()
        got += weights.jump * jumps(old, _matrices(f.step), frame, _matrices(f.h_before))[frame > f["first"].to_numpy()].sum()
        return pd.DataFrame({"video_id": f.video_id.iloc[:1], "seg": f.seg.iloc[:1], "gain": [got]})

    gained = paired(tried, pts, "grp", gain, "video_id long, seg long, gain double").groupBy(*key).agg(F.sum("gain").alias("gain"))
    better = gained.where("gain > 0").join(best, key).select(*key, "best")
    chosen = rows.join(h, FRAME).join(better, key, "left").select(*FRAME, "h", "start", "chain", "best")

    def carried(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            new = normal(_matrices(f.best) @ _matrices(f.start) @ np.linalg.pinv(_matrices(f.chain)))
            yield f.assign(h=[old if b is None else m.ravel().tolist() for old, b, m in zip(f.h, f.best, new)])[[*FRAME, "h"]]

    return chosen.mapInPandas(carried, f"video_id long, frame_id long, h {_MATRIX}")
