"""Ball tracks: outlier removal, online gate, interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..runtime import ship

FRAME = ["video_id", "frame_id"]


def cheapest_chain(frames: np.ndarray, x: np.ndarray, y: np.ndarray, conf: np.ndarray, off: np.ndarray, look_back: int = 50, skip: float = 0.5, gain: float = 0.01, outside: float = 0.02, jump: float = 3.0) -> list[int]:
    """At most one candidate of each frame, minimising skipped frames, jumps and distances off court less confidences.

    Frames count as steps only if they have candidates; a step looks back ``look_back`` of them. One array operation for each frame.
    """
    ids, start = np.unique(frames, return_index=True)
    n = len(ids)
    step = np.searchsorted(ids, frames) + 1
    own = outside * off - gain * conf
    cost, before = np.full(len(frames), np.inf), np.full(len(frames), -1)
    stop = np.append(start, len(frames))
    for i in range(1, n + 1):
        mine = np.arange(stop[i - 1], stop[i])
        low = max(0, i - look_back)
        prev = np.arange(stop[max(low - 1, 0)] if low > 0 else 0, stop[i - 1])
        best, by = np.full(len(mine), np.inf), np.full(len(mine), -1)
        if low == 0:
            best = (i - 1) * skip + own[mine]
        if len(prev):
            d = np.hypot(x[mine][:, None] - x[prev], y[mine][:, None] - y[prev])
            total = cost[prev] + (i - step[prev] - 1) * skip + jump * d + own[mine][:, None]
            k = total.argmin(1)
            value = total[np.arange(len(mine)), k]
            better = value < best
            best, by = np.where(better, value, best), np.where(better, prev[k], by)
        cost[mine], before[mine] = best, by
    end = np.flatnonzero(step >= n + 1 - look_back)
    if not len(end):
        return []
    at = int(end[(cost[end] + (n - step[end]) * skip).argmin()])
    chain = []
    while at >= 0:
        chain.append(at)
        at = int(before[at])
    return chain[::-1]


def remove_outliers(balls: DataFrame, width: int, height: int, least: float = 0.3) -> DataFrame:
    """The balls of the cheapest chain of each video; ``off_court`` (distance beyond the court, normalised) may be given."""
    ship(balls.sparkSession)
    some = balls.where(F.col("confidence") >= least)
    if "off_court" not in some.columns:
        some = some.withColumn("off_court", F.lit(0.0))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_id", "det_idx"]).reset_index(drop=True)
        x, y = (pdf.x1 + pdf.x2) / 2 / width, (pdf.y1 + pdf.y2) / 2 / height
        return pdf.iloc[cheapest_chain(*(np.asarray(c, float) for c in (pdf.frame_id, x, y, pdf.confidence, pdf.off_court)))]

    return some.groupBy("video_id").applyInPandas(pick, some.schema).drop(*({"off_court"} - set(balls.columns)))


def gate(candidates: list[tuple[float, float, float]], last: tuple[float, float] | None, most: float) -> tuple[float, float, float] | None:
    """The best-scored candidate nearer than ``most`` to the last accepted one (any, if there is none yet)."""
    near = [c for c in candidates if last is None or (c[0] - last[0]) ** 2 + (c[1] - last[1]) ** 2 < most**2]
    return max(near, key=lambda c: c[2], default=None)


def gated(candidates: DataFrame, most: float = 300.0, half: int = 10) -> DataFrame:
    """One accepted ball for each frame, walking each video's frames in order; boxes of ``half`` pixels around it.

    The last accepted place decides on the next and never expires, so a video is walked by one task.
    """
    ship(candidates.sparkSession)
    frames = candidates.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("cand_idx", "x", "y", "score"))).alias("c"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for video, frame, c in pdf.sort_values("frame_id")[["video_id", "frame_id", "c"]].itertuples(index=False):
            got = gate([(k["x"], k["y"], k["score"]) for k in c], last, most)
            if got:
                last = got[:2]
                out.append((video, frame, *got, int(got[0]) - half, int(got[1]) - half, int(got[0]) + half, int(got[1]) + half))
        return pd.DataFrame(out, columns=["video_id", "frame_id", "x", "y", "score", "x1", "y1", "x2", "y2"])

    return frames.groupBy("video_id").applyInPandas(walk, "video_id long, frame_id long, x double, y double, score double, x1 long, y1 long, x2 long, y2 long")


def merge_windows(windows: DataFrame) -> DataFrame:
    """Candidates of overlapping frame windows (frame_ids and candidates arrays) as rows of frames, numbered in window order."""
    flat = windows.select("video_id", "window_idx", F.posexplode(F.arrays_zip("frame_ids", "candidates")).alias("p", "z"))
    each = flat.select("video_id", F.col("z.frame_ids").alias("frame_id"), "window_idx", F.posexplode("z.candidates").alias("q", "c")).select(*FRAME, "window_idx", "q", "c.*")
    w = Window.partitionBy(*FRAME).orderBy("window_idx", "q")
    return each.withColumn("cand_idx", F.row_number().over(w) - 1).drop("window_idx", "q")


def interpolate(balls: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Balls with gaps up to ``ball_gap_frames`` filled linearly, rounded half-even, confidence 0."""
    w = Window.partitionBy("video_id").orderBy("frame_id")
    box = ("x1", "y1", "x2", "y2")
    nxt = F.lead(F.struct("frame_id", *box)).over(w)
    gaps = balls.select(*FRAME, *box, nxt.alias("n")).withColumn("gap", F.col("n.frame_id") - F.col("frame_id")).where((F.col("gap") > 1) & (F.col("gap") - 1 <= cfg.ball_gap_frames))
    filled = gaps.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("gap") - 1)).alias("k"))
    t = F.col("k") / F.col("gap")
    new = {c: F.bround(F.col(c) + (F.col(f"n.{c}") - F.col(c)) * t).cast("long") for c in box}
    rows = filled.select("video_id", (F.col("frame_id") + F.col("k")).alias("frame_id"), F.lit(0.0).alias("confidence"), *(v.alias(c) for c, v in new.items()))
    rows = rows.withColumn("x2", F.greatest("x2", F.col("x1") + 1)).withColumn("y2", F.greatest("y2", F.col("y1") + 1))
    return balls.select(*FRAME, "confidence", *box).unionByName(rows)
