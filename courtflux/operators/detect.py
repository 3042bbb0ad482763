"""From detections to players, balls, referees, rims and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions import geometry as G
from .relops import top_k

FRAME = ["video_id", "frame_id"]
BEST = [F.desc_nulls_last, F.col]

#: Class ids of the default taxonomy, and of the alternative one.
CLASSES = {"ball": (0, 0), "number": (1, 1), "player": (2, 8), "dribble": (3, 3), "referee": (9, 9), "rim": (10, 10)}
CLASSES_ALT = {"ball": (0, 0), "player": (1, 1), "rim": (5, 5)}


def of_class(df: DataFrame, kind: str, conf: float, taxonomy: dict[str, tuple[int, int]] = CLASSES) -> DataFrame:
    low, high = taxonomy[kind]
    return df.where(F.col("class_id").between(low, high) & (F.col("confidence") >= conf))


def nms(df: DataFrame, threshold: float = DEFAULT.nms_threshold) -> DataFrame:
    """Greedy suppression in each frame: by falling confidence (then det_idx) a box stays unless a box that stayed overlaps it.

    The kept boxes decide, so it is a fold over the frame's sorted boxes; a frame has few.
    """
    rest = [c for c in df.columns if c not in FRAME]
    first = [c for c in ("confidence", "det_idx") if c in rest]
    order = F.struct((-F.col("confidence")).alias("__o"), F.col("det_idx").alias("__i"), *(F.col(c) for c in rest))
    boxes = df.groupBy(*FRAME).agg(F.array_sort(F.collect_list(order)).alias("__all"))
    assert len(first) == 2

    def step(kept: Column, x: Column) -> Column:
        a = G.box_of(x)
        hit = F.exists(kept, lambda k: (G.iou(a, G.box_of(k)) >= threshold) | (G.overlap_ratio(a, G.box_of(k)) >= threshold))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("__all", F.slice(F.col("__all"), 1, 0), step)
    return boxes.select(*FRAME, F.explode(kept).alias("__k")).select(*FRAME, *(F.col(f"__k.{c}").alias(c) for c in rest))


def by_confidence() -> list[Column]:
    return [F.desc("confidence"), F.col("det_idx")]


def players(df: DataFrame, cfg: Config = DEFAULT, taxonomy: dict[str, tuple[int, int]] = CLASSES, suppress: bool = True) -> DataFrame:
    """At most ``max_players`` of a frame; player_id is the rank by confidence, is_dribble the class."""
    some = of_class(df, "player", cfg.conf, taxonomy)
    kept = top_k(nms(some, cfg.nms_threshold) if suppress else some, FRAME, by_confidence(), cfg.max_players, "player_id")
    return kept.withColumn("is_dribble", F.col("class_id") == 3)


def referees(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return top_k(of_class(df, "referee", cfg.conf), FRAME, by_confidence(), cfg.max_referees)


def best(df: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """The most confident row of each frame (null counts as 0, the first wins)."""
    own = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*own), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("det_idx")))
    return df.groupBy(*keys).agg(pick.alias("__x")).select(*keys, "__x.*")


def best_ball(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return best(of_class(df, "ball", cfg.conf))


def best_rim(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return best(of_class(df, "rim", cfg.conf))


def left_right_rims(rims: DataFrame) -> DataFrame:
    """The most confident rim of each side; the side is the projected x's sign, else the half of the picture (x_rel)."""
    side = F.when(F.coalesce(F.col("court_x") < 0, F.col("x_rel") < 0.5), "left").otherwise("right")
    return top_k(rims.withColumn("side", side), [*FRAME, "side"], by_confidence(), 1)


def drop_short_tracks(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks seen in fewer than ``min_hits`` rows lose their id."""
    hits = F.count("*").over(Window.partitionBy("video_id", "player_id"))
    return df.withColumn("player_id", F.when((F.col("player_id") >= 0) & (hits < cfg.min_hits), -1).otherwise(F.col("player_id")))


def on_court(df: DataFrame, half_length: float = 15.0, half_width: float = 8.0) -> DataFrame:
    """Rows with a position on the court, and with a mask if any row of the frame has one."""
    any_mask = F.max(F.col("has_mask").cast("int")).over(Window.partitionBy(*FRAME)) == 1
    there = (F.abs("court_x") <= half_length) & (F.abs("court_y") <= half_width)
    return df.withColumn("__any", any_mask).where(there & (~F.col("__any") | F.col("has_mask"))).drop("__any")


def edge_flags(df: DataFrame, cfg: Config = DEFAULT, width: int | None = None) -> DataFrame:
    """Whether a box touches the picture's left or right edge; an unknown width is the largest x2 of the video."""
    w = F.lit(width) if width else F.max("x2").over(Window.partitionBy("video_id"))
    return df.withColumn("__w", w).withColumn("near_edge", G.near_edge(G.box(), F.col("__w"), cfg.edge_margin)).drop("__w")


def vote_numbers(votes: DataFrame, cfg: Config = DEFAULT, mode: str | None = None) -> DataFrame:
    """A number for each OCR'd box: the strict majority of its valid votes, or what all votes say; with the mean confidence.

    Votes are rows (video_id, frame_id, det_idx, variant, num, conf); invalid ones have a null num or a confidence below the limit.
    """
    keys = [*FRAME, "det_idx"]
    ok = F.col("num").isNotNull() & (F.col("conf") >= cfg.ocr_conf)
    n = Window.partitionBy(*keys)
    each = votes.withColumn("valid", F.sum(ok.cast("int")).over(n)).withColumn("asked", F.count("*").over(n)).where(ok)
    counts = each.groupBy(*keys, "num").agg(F.count("*").alias("votes"), F.avg("conf").alias("confidence"), F.first("valid").alias("valid"), F.first("asked").alias("asked"))
    wins = F.col("votes") * 2 > F.col("valid") if (mode or cfg.vote_mode) == "majority" else F.col("votes") == F.col("asked")
    return counts.where(wins).select(*keys, "num", "confidence")


def best_ocr(candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The most confident number of each box, if it reaches the limit."""
    keys = [*FRAME, "det_idx"]
    got = candidates.where(F.col("num").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct("num", "conf"), F.struct("conf", -F.col("variant"))).alias("x"))
    return got.where(F.col("x.conf") >= cfg.ocr_conf).select(*keys, F.col("x.num").alias("num"), F.col("x.conf").alias("confidence"))
