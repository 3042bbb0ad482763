"""Joins that give players numbers, poses and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions import geometry as G
from .detect import FRAME
from .relops import first_seen, top_k


def prefixed(df: DataFrame, prefix: str, keys: list[str] = FRAME) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys))


def match_numbers(players: DataFrame, numbers: DataFrame, referees: DataFrame) -> DataFrame:
    """Players with the number inside exactly one player's box and no referee's; of several a player keeps the first."""
    num = prefixed(numbers, "n_")
    in_ref = num.join(prefixed(referees, "r_"), FRAME).where(G.contains(G.box("r_"), G.box("n_")))
    free = num.join(in_ref.select(*FRAME, "n_det_idx").distinct(), [*FRAME, "n_det_idx"], "left_anti")
    inside = free.join(prefixed(players, "p_"), FRAME).where(G.contains(G.box("p_"), G.box("n_")))
    owners = F.count("*").over(Window.partitionBy(*FRAME, "n_det_idx"))
    one = inside.withColumn("__n", owners).where("__n = 1")
    own = top_k(one, [*FRAME, "p_det_idx"], [F.col("n_det_idx")], 1)
    return own.select(*FRAME, F.col("p_det_idx").alias("det_idx"), F.col("n_det_idx").alias("number_det_idx"))


def pair_ious(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l_det_idx, r_det_idx and iou of a frame's pairs at or over a least IoU."""
    pairs = prefixed(left, "l_").join(prefixed(right, "r_"), FRAME)
    return pairs.select(*FRAME, "l_det_idx", "r_det_idx", G.iou(G.box("l_"), G.box("r_")).alias("iou")).where(F.col("iou") >= least)


def greedy_pairs(pairs: DataFrame, keys: list[str], score: str, a: str, b: str) -> DataFrame:
    """One-to-one pairs: by falling score (then a, b) a pair stays if neither side is taken. A fold over each key's few pairs."""
    order = F.struct((-F.col(score)).alias("o"), F.col(a).alias("a"), F.col(b).alias("b"))
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("all"))

    def step(kept: Column, x: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["a"] == x["a"]) | (k["b"] == x["b"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(x)))

    kept = grouped.select(*keys, F.explode(F.aggregate("all", F.slice(F.col("all"), 1, 0), step)).alias("k"))
    return kept.select(*keys, F.col("k.a").alias(a), F.col("k.b").alias(b), (-F.col("k.o")).alias(score))


def match_poses_greedy(players: DataFrame, poses: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return greedy_pairs(pair_ious(players, poses, cfg.pose_iou), FRAME, "iou", "l_det_idx", "r_det_idx")


def match_poses_best(players: DataFrame, poses: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each player's pose of the largest IoU; a pose may serve several players."""
    return top_k(pair_ious(players, poses, cfg.pose_iou), [*FRAME, "l_det_idx"], [F.desc("iou"), F.col("r_det_idx")], 1)


def match_masks(boxes: DataFrame, masks: DataFrame) -> DataFrame:
    """Each box's mask (by its bounding box) of the largest IoU above 0; boxes and masks without a whole pixel have none."""
    some = "x2 > x1 and y2 > y1"
    return top_k(pair_ious(boxes.where(some), masks.where(some), 0.0).where("iou > 0"), [*FRAME, "l_det_idx"], [F.desc("iou"), F.col("r_det_idx")], 1)


def track_numbers(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each track's most frequent number if its share is large enough; ties go to the number seen first."""
    some = rows.where("player_id >= 0 and num is not null")
    each = some.groupBy("video_id", "player_id", "num").agg(F.count("*").alias("n"), F.min(F.struct("frame_id", "det_idx")).alias("first"))
    total = F.sum("n").over(Window.partitionBy("video_id", "player_id"))
    best = top_k(each.withColumn("total", total), ["video_id", "player_id"], [F.desc("n"), F.col("first")], 1)
    return best.where(F.col("n") / F.col("total") >= cfg.track_number_min_share).select("video_id", "player_id", F.col("num").alias("track_number"))


def with_track_numbers(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return rows.join(track_numbers(rows, cfg), ["video_id", "player_id"], "left")


def look_up(rows: DataFrame, value: str) -> DataFrame:
    """A player's first value of a column, in frame order."""
    return first_seen(rows, ["video_id", "player_id"], value, ["frame_id", "det_idx"])


def sampled(balls: DataFrame, frames: DataFrame) -> DataFrame:
    """Only balls of sampled frames."""
    return balls.join(frames.select(*FRAME), FRAME, "left_semi")


def nearest_hand(hands: DataFrame, balls: DataFrame, most: float = 30.0) -> DataFrame:
    """The ball handler of a frame: the wrist nearest to the ball within ``most`` pixels."""
    at = hands.join(balls.select(*FRAME, F.col("cx").alias("bx"), F.col("cy").alias("by")), FRAME)
    far = at.withColumn("distance", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")))
    return top_k(far, FRAME, [F.col("distance"), F.col("det_idx")], 1).where(F.col("distance") <= most).drop("bx", "by")
