"""The court: model points, homographies, embeddings of frames, reprojection errors."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..runtime import ship, written
from .detect import FRAME

#: Fixed values by court type, in metres: half length and width; corner mark, its length, key width, free-throw line, rim, arc, box line.
COURTS = {
    "fiba": (14.0, 7.5, 0.9, 3.0, 4.8, 5.8, 1.22, 1.6 + 6.75, 8.33),
    "nba": (14.325, 7.62, 0.91, 3.0, 4.88, 5.79, 1.22, 1.6 + 7.24, 8.53),
}
SIZES = {"fiba": (28.0, 15.0), "nba": (28.65, 15.24)}
POINTS = 33


def court_points(court: str) -> list[tuple[int, float, float]]:
    """The 33 model points (class, x, y): the left half, the middle, and the left half mirrored."""
    length, width, mark, mark_in, key, line, rim, arc, box = COURTS[court]
    left = [(0, width), (0, width - mark), (mark_in, width - mark), (0, key / 2), (line, key / 2), (rim, 0), (line, 0), (arc, 0), (0, -key / 2), (line, -key / 2), (0, -width), (0, -width + mark), (mark_in, -width + mark)]
    out = [(i, x - length, y) for i, (x, y) in enumerate(left)]
    out += [(13 + i, 0.0, y) for i, y in enumerate((width, 0.0, -width))]
    out += [(16 + i, length - x, y) for i, (x, y) in enumerate(left)]
    return out + [(29, box - length, width), (30, box - length, -width), (31, length - box, width), (32, length - box, -width)]


def mirrored(i: int) -> int:
    """The class that a point has in the mirrored court."""
    if i < 13 or 16 <= i < 29:
        return i + 16 if i < 13 else i - 16
    return {13: 15, 14: 14, 15: 13, 29: 31, 30: 32, 31: 29, 32: 30}[i]


def points_table(spark: SparkSession, court: str) -> DataFrame:
    length, width = SIZES[court]
    rows = [(i, float(x), float(y), x / length, y / width, mirrored(i)) for i, x, y in court_points(court)]
    return spark.createDataFrame(rows, "point int, x double, y double, u double, v double, mirror int")


def project(rows: DataFrame, homographies: DataFrame, width: int, height: int, court: str = "nba") -> DataFrame:
    """Rows with court_x, court_y of their foot points; null without a homography."""
    x, y = G.to_court(F.col("h"), G.box(), F.lit(width), F.lit(height), *SIZES[court])
    return rows.join(homographies, FRAME, "left").withColumn("court_x", x).withColumn("court_y", y).drop("h")


def keypoint_slots(homographies: DataFrame, court: str) -> DataFrame:
    """The model points that a frame shows, by the inverse homography."""
    length, width = SIZES[court]
    points = F.array(*(F.struct(F.lit(i).alias("point"), F.lit(x / length).alias("u"), F.lit(y / width).alias("v")) for i, x, y in court_points(court)))
    inv = homographies.withColumn("inv", G.inverse(F.col("h"))).where("inv is not null").select("*", F.inline(points))
    x, y = G.project(F.col("inv"), F.col("u"), F.col("v"), 1e-8)
    return inv.select(*FRAME, "point", x.alias("px"), y.alias("py")).where(F.col("px").between(0, 1) & F.col("py").between(0, 1))


def frame_embedding(frames: DataFrame, balls: DataFrame, rims: DataFrame, slots: DataFrame) -> DataFrame:
    """112 numbers a frame: ball (x, y, conf), left and right rim (x1, y1, x2, y2, conf), 33 points (x, y, there); zeros where absent."""
    zero = lambda n: F.array(*[F.lit(0.0)] * n)
    ball = balls.select(*FRAME, F.array("bx", "by", "conf").alias("ball"))
    rim = rims.select(*FRAME, "side", F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "confidence"))).alias("r")).groupBy(*FRAME).pivot("side", ["left", "right"]).agg(F.first("r"))
    at = slots.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("point", F.array("px", "py", F.lit(1.0))))).alias("p"))
    joined = frames.join(ball, FRAME, "left").join(rim, FRAME, "left").join(at, FRAME, "left")
    points = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.coalesce(F.try_element_at("p", i), zero(3))))
    return joined.select(*FRAME, F.concat(F.coalesce("ball", zero(3)), F.coalesce("left", zero(5)), F.coalesce("right", zero(5)), points).alias("embedding"))


# -- homographies in numpy -----------------------------------------------------------------------------------------------------


def apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    w = np.where(np.abs(q[:, 2:]) < 1e-12, 1e-12, q[:, 2:])
    return q[:, :2] / w


def from_points(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homographies of batches of four or more point pairs, by the null vector of the linear constraints."""
    x, y = src[..., 0], src[..., 1]
    u, v = dst[..., 0], dst[..., 1]
    o, z = np.ones_like(x), np.zeros_like(x)
    a = np.stack([x, y, o, z, z, z, -u * x, -u * y, -u], -1)
    b = np.stack([z, z, z, x, y, o, -v * x, -v * y, -v], -1)
    return np.linalg.svd(np.concatenate([a, b], -2))[2][..., -1, :].reshape(*src.shape[:-2], 3, 3)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``np.cross`` of vectors of three, which is slow."""
    x, y, z = (a[..., i] for i in range(3))
    u, v, w = (b[..., i] for i in range(3))
    return np.stack([y * w - z * v, z * u - x * w, x * v - y * u], -1)


def from_four(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homographies of batches of four point pairs, up to scale: through the projective frames that both fours span; 0 where three lie on a line."""

    def frame(p: np.ndarray) -> list[list[np.ndarray]]:
        """The columns of the frames' matrices, each by component: numbers of all fours beside one another."""
        q = np.ascontiguousarray(p.reshape(-1, 8).T)
        a, b, c, d = ((q[2 * i], q[2 * i + 1]) for i in range(4))
        scale = [(x[1] - y[1]) * d[0] + (y[0] - x[0]) * d[1] + (x[0] * y[1] - x[1] * y[0]) for x, y in ((b, c), (c, a), (a, b))]
        return [[x[0] * k, x[1] * k, k] for x, k in zip((a, b, c), scale)]

    def cross(u: list[np.ndarray], v: list[np.ndarray]) -> list[np.ndarray]:
        return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    (a, b, c), to = frame(src), frame(dst)
    rows = (cross(b, c), cross(c, a), cross(a, b))
    out = np.empty((src.size // 8, 3, 3))
    for i in range(3):
        for j in range(3):
            out[:, i, j] = to[0][i] * rows[0][j] + to[1][i] * rows[1][j] + to[2][i] * rows[2][j]
    return out.reshape(*src.shape[:-2], 3, 3)


def first_four(x: np.ndarray) -> np.ndarray:
    """The places of each row's four smallest numbers, smallest first."""
    if x.shape[1] <= 12:
        return x.argsort(1)[:, :4]
    some = np.argpartition(x, 3, 1)[:, :4]
    return np.take_along_axis(some, np.take_along_axis(x, some, 1).argsort(1), 1)


@cache
def _all_fours(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 4)))


def fours(n: int, tries: int, seed: int | tuple[int, ...]) -> np.ndarray:
    """Fours of n places: every four once if that makes at most ``tries``, else so many drawn ones."""
    if comb(n, 4) <= tries:
        return _all_fours(n)
    return first_four(np.random.default_rng(seed).random((tries, n)))


def drawn_fours(n: int, tries: int, seed: int | tuple[int, ...]) -> np.ndarray:
    """As ``fours``, but a drawn one takes four numbers, however many places there are: each is drawn from the places that are left."""
    if comb(n, 4) <= tries:
        return _all_fours(n)
    pick = np.random.default_rng(seed).integers(0, n - np.arange(4), (tries, 4))
    for k in range(1, 4):
        for before in np.sort(pick[:, :k], 1).T:  # places taken before, smallest first, are passed over
            pick[:, k] += pick[:, k] >= before
    return pick


def ransac(src: np.ndarray, dst: np.ndarray, tries: int = 1000, eps: float = 0.005, seed: int = 0) -> np.ndarray | None:
    """The homography of four of the pairs with the best soft agreement of directions over all; null under four pairs."""
    n = len(src)
    if n < 4:
        return None
    pick = fours(n, tries, seed)
    h = from_four(src[pick], dst[pick])
    a, b = np.stack([*src.T, np.ones(n)]), np.stack([*dst.T, np.ones(n)])
    x, y, w = (h.reshape(-1, 3) @ a).reshape(len(h), 3, n).swapaxes(0, 1)  # by component: fours beside points
    cos = (x * b[0] + y * b[1] + w) / np.maximum(np.sqrt((x * x + y * y + w * w)) * np.sqrt((b * b).sum(0)), 1e-12)
    best = h[np.exp((np.abs(cos) - 1) / eps**2).sum(1).argmax()]
    return best / best[2, 2] if abs(best[2, 2]) > 1e-12 else best


def distance(a: np.ndarray, b: np.ndarray, image_side: bool = True) -> float:
    """How far two homographies turn nine probe vectors, both ways; probes in the picture (or on the court)."""
    t = (0, 0.5, 1) if image_side else (-0.5, 0, 0.5)
    v = np.array([(x, y, 1.0) for x in t for y in t])
    ia, ib = np.linalg.pinv(a), np.linalg.pinv(b)
    total = 0.0
    for d in ((ia @ b, ib @ a) if image_side else (b @ ia, a @ ib)):
        w = v @ d.T
        total += (1 - (w * v).sum(1) / (np.linalg.norm(w, axis=1) * np.linalg.norm(v, axis=1))).sum()
    return float(total)


#: Frames of a video that are fitted in one call.
BLOCK = 64


def _by_frame(points: DataFrame, fit: Callable[[np.ndarray, np.ndarray, int], np.ndarray | None], seed: int) -> DataFrame:
    """A homography (or null) of each frame's keypoints (sx, sy) -> (dx, dy); ``fit`` gets a seed from the frame's keys."""
    ship(points.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id", kind="stable")
        frame, video = pdf.frame_id.to_numpy(), int(pdf.video_id.iloc[0])
        src, dst = pdf[["sx", "sy"]].to_numpy(float), pdf[["dx", "dy"]].to_numpy(float)
        cuts = np.flatnonzero(frame[1:] != frame[:-1]) + 1
        out = []
        for f, x, y in zip(frame[np.concatenate([[0], cuts])].tolist(), np.split(src, cuts), np.split(dst, cuts)):
            h = fit(x, y, seed + video * 1_000_003 + int(f))
            out.append((video, f, None if h is None else h.ravel().tolist()))
        return pd.DataFrame(out, columns=["video_id", "frame_id", "h"])

    # Points are few beside the work they make, so small partitions aren't merged.
    keyed = points.withColumn("__block", F.floor(F.col("frame_id") / BLOCK)).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id", "__block")
    return keyed.groupBy("video_id", "__block").applyInPandas(run, "video_id long, frame_id long, h array<double>")


def fit_frames(points: DataFrame, seed: int = 0) -> DataFrame:
    """A homography for each frame from its keypoints (sx, sy) -> (dx, dy); frames are independent, seeded by their keys."""
    return _by_frame(points, lambda src, dst, own: ransac(src, dst, seed=own), seed)


def homographies_of(points: DataFrame, stored: DataFrame, seed: int = 0) -> DataFrame:
    """Each frame's homography: the stored one, else the one that its keypoints give (none under four of them); ``stored`` tells which."""
    missing = points.join(stored.select(*FRAME), FRAME, "left_anti")
    made = fit_frames(missing, seed).where("h is not null").withColumn("stored", F.lit(False))
    return stored.select(*FRAME, "h").withColumn("stored", F.lit(True)).unionByName(made)


def least_squares(points: DataFrame, keep: float = 0.02, tries: int = 200, seed: int = 0) -> DataFrame:
    """The baseline homography of each frame: that of four pairs with the most pairs within ``keep``, fitted anew to all of those."""

    def fit(src: np.ndarray, dst: np.ndarray, own: int) -> np.ndarray | None:
        if len(src) < 4:
            return None
        pick = fours(len(src), tries, own)
        to = np.c_[src, np.ones(len(src))] @ np.swapaxes(from_four(src[pick], dst[pick]), 1, 2)  # of all fours at once
        off = to[..., :2] / np.where(np.abs(to[..., 2:]) < 1e-12, 1e-12, to[..., 2:]) - dst
        near = np.hypot(off[..., 0], off[..., 1]) <= keep
        inside = near[near.sum(1).argmax()]
        if inside.sum() < 4:
            return None
        h = from_points(src[inside], dst[inside])
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h

    return _by_frame(points, fit, seed)


def grid_errors(pairs: DataFrame, court: str, side: int = 20) -> DataFrame:
    """For (gt, pred) homographies the errors in metres of the grid points that the frame shows, as rows."""
    ship(pairs.sparkSession)
    length, width = SIZES[court]
    n = side - 1
    cell = np.arange(side * side)
    at = np.stack([cell % side / n - 0.5, cell // side / n - 0.5, np.ones(side * side)])

    # In numpy: as columns the grid's projections, one within the other, make code too long to compile.
    @F.pandas_udf("array<double>")
    def errors(gt: pd.Series, pred: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(gt), 256):
            m, h = (np.array([[np.nan if x is None else x for x in m] for m in c.iloc[i : i + 256]], float).reshape(-1, 3, 3) for c in (gt, pred))
            with np.errstate(all="ignore"):
                rest = np.stack([_cross(m[:, 1], m[:, 2]), _cross(m[:, 2], m[:, 0]), _cross(m[:, 0], m[:, 1])], -1)
                det = (m[:, 0] * rest[:, :, 0]).sum(-1)
                p = rest / np.where(np.abs(det) > 1e-12, det, np.nan)[:, None, None] @ at
                p = p / p[:, 2:]
                q = h @ p
                error = np.hypot((at[0] - q[:, 0] / q[:, 2]) * length, (at[1] - q[:, 1] / q[:, 2]) * width)
                error[~((p[:, :2] >= 0) & (p[:, :2] <= 1)).all(1)] = -1
            out += list(error)
        return pd.Series(out, dtype=object)

    shown = pairs.where("gt is not null and pred is not null").withColumn("errors", errors("gt", "pred")).select(*pairs.columns, F.posexplode("errors").alias("cell", "error")).where("error <> -1")
    return shown.select(*pairs.columns, (F.col("cell") % side / n - 0.5).alias("u"), (F.floor(F.col("cell") / side) / n - 0.5).alias("v"), "error")


#: Buckets of errors that are counted on the way to a median, for each doubling.
FINE = 1024


def error_summary(errors: DataFrame, key: str = "video_id") -> DataFrame:
    """RMSE, mean and median for each video, and over all (``overall``); null errors count as points alone, nan is above all numbers.

    The medians are exact: errors are counted by buckets of their size, and only the buckets that hold the middle ones are sorted, so no
    group's errors are held at once.
    """
    e = F.col("error")
    size = F.when(F.isnan(e), F.lit(2.0**40)).when(e == 0, F.lit(-(2.0**40))).otherwise(F.floor(F.log2(F.abs(e)) * FINE) * 2.0 + 1)
    bucket = F.when(e.isNotNull(), F.when(e < 0, -size).otherwise(size)).alias("bucket")
    rows = errors.select(F.col(key).alias("k"), "error", bucket)
    of_key = rows.groupBy("k", "bucket").agg(F.count("error").alias("n"), F.sum("error").alias("s"), F.sum(e * e).alias("s2"), F.count("*").alias("points"))
    sums = written(of_key.withColumn("overall", F.lit(False)))
    whole = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", "s", "s2", "points"))).withColumn("overall", F.lit(True)).withColumn("k", F.lit(None).cast(rows.schema["k"].dataType))
    counted = sums.unionByName(whole)
    group = Window.partitionBy("overall", "k")
    before = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.where("bucket is not null").select("overall", "k", "bucket", "n", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(group).alias("total"))
    middle = written(placed.selectExpr("*", "(total - 1) div 2 AS lo", "total div 2 AS hi").where("before <= hi AND lo < before + n").drop("n", "total"))  # one or two rows a group
    each = rows.withColumnRenamed("k", "of").withColumnRenamed("bucket", "b")
    own = middle.where("not overall").join(each, F.expr("k <=> of AND bucket = b"))
    inside = own.unionByName(middle.where("overall").join(each, F.expr("bucket = b"))).drop("of", "b")
    rank = F.row_number().over(Window.partitionBy("overall", "k", "bucket").orderBy("error")) - 1 + F.col("before")
    median = inside.withColumn("rank", rank).where("rank IN (lo, hi)").groupBy("overall", "k").agg(F.avg("error").alias("median"))
    n, total = F.sum("n"), counted.groupBy("overall", "k")
    summed = total.agg(F.sqrt(F.sum("s2") / n).alias("rmse"), (F.sum("s") / n).alias("mean"), F.sum("points").alias("points"))
    found = median.select(F.col("overall").alias("o"), F.col("k").alias("of"), "median")
    return summed.join(found, F.expr("overall = o AND k <=> of"), "left").select(F.col("k").alias(key), "overall", "rmse", "mean", "median", "points")


# -- augmentation --------------------------------------------------------------------------------------------------------------


def augment_points(points: DataFrame, flip: bool = False, **move: float) -> DataFrame:
    """Keypoints (point, px, py) under an affine map about the picture's centre; a flip mirrors x and takes each point's mirrored class."""
    x, y = G.affine(F.col("px"), F.col("py"), **move)
    if not flip:
        return points.withColumn("__x", x).withColumn("py", y).withColumn("px", F.col("__x")).drop("__x")
    to = F.element_at(F.array(*(F.lit(mirrored(i)) for i in range(POINTS))), F.col("point") + 1)
    return points.withColumn("__x", 1 - x).withColumn("py", y).withColumn("px", F.col("__x")).withColumn("point", to).drop("__x")


def augment_boxes(boxes: DataFrame, flip: bool = False, **move: float) -> DataFrame:
    """Boxes (x1..y2 in [0, 1]) under the same map: the box around the moved corners."""
    corners = [G.affine(F.col(a), F.col(b), **move) for a in ("x1", "x2") for b in ("y1", "y2")]
    xs, ys = [1 - x if flip else x for x, _ in corners], [y for _, y in corners]
    new = {"x1": F.least(*xs), "y1": F.least(*ys), "x2": F.greatest(*xs), "y2": F.greatest(*ys)}
    return boxes.withColumns(new)
