"""Who holds the ball: per-frame owners, possession intervals, passes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..runtime import ship
from .detect import FRAME
from .relops import band_join, top_k


def frame_owners(players: DataFrame, balls: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Players with ``is_possession``: the one whose grown box holds the frame's ball, else those who dribble; never untracked ones.

    ``balls`` has at most one row a frame (video_id, frame_id, x1..y2).
    """
    ball = balls.select(*FRAME, ((F.col("x1") + F.col("x2")) * 0.5).alias("__bx"), ((F.col("y1") + F.col("y2")) * 0.5).alias("__by"))
    near = G.holds(G.expanded(G.box(), cfg.expand_share, cfg.expand_least), F.col("__bx"), F.col("__by"))
    inside = F.coalesce(near & (F.col("player_id") != -1), F.lit(False))
    w = Window.partitionBy(*FRAME)
    joined = players.join(ball, FRAME, "left").withColumn("__in", inside)
    one = joined.withColumn("__n", F.sum(F.col("__in").cast("int")).over(w)).withColumn("__owner", F.max(F.when(F.col("__in"), F.col("player_id"))).over(w))
    has = F.when(F.col("player_id") == -1, False).when(F.col("__n") == 1, F.col("player_id") == F.col("__owner")).otherwise(F.col("is_dribble"))
    return one.withColumn("is_possession", has).withColumn("is_possession_raw", has).drop("__bx", "__by", "__in", "__n", "__owner")


def hand_owners(hands: DataFrame, balls: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Alternate mode: every player whose nearest wrist is under ``hand_distance`` from the ball (several may hold it)."""
    at = hands.join(balls.select(*FRAME, F.col("cx").alias("bx"), F.col("cy").alias("by")), FRAME)
    far = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    return at.groupBy(*FRAME, "player_id").agg(F.min(far).alias("distance")).where((F.col("distance") < cfg.hand_distance) & (F.col("player_id") != -1))


def half_second(fps: float, seconds: float = 0.5) -> int:
    return max(1, round(seconds * fps)) if fps > 0 else 1


def segments_of(frames: list[int], hits: list[list[int]], half: int, other_share: float, owner_share: float | None) -> list[tuple[int, int, int]]:
    """Greedy longest intervals with one dominant player, by prefix sums.

    From frame i a candidate owner is a player seen there. The first window of ``half`` frames that the owner does not lead bounds the end;
    within that bound all ends are tested at once, and the last valid one is taken.
    """
    ids = sorted({p for h in hits for p in h})
    n = len(frames)
    if n < half or not ids:
        return []
    row = {p: k for k, p in enumerate(ids)}
    seen = np.zeros((len(ids), n), np.int64)
    for j, h in enumerate(hits):
        for p in h:
            seen[row[p], j] = 1
    total = np.concatenate([np.zeros((len(ids), 1), np.int64), seen.cumsum(1)], 1)
    window = total[:, half:] - total[:, :-half]
    lost = {}
    out, i = [], 0
    while i <= n - half:
        best, owner = -1, None
        for p in dict.fromkeys(hits[i]):
            k = row[p]
            if k not in lost:
                rest = np.delete(window, k, 0)
                bad = window[k] <= (rest.max(0) if len(rest) else 0)
                after = np.where(bad, np.arange(len(bad)), len(bad))
                lost[k] = np.minimum.accumulate(after[::-1])[::-1]
            stop = int(lost[k][i]) + half - 1  # ends from here on hold a window that p does not lead
            ends = np.arange(i + half - 1, min(stop, n))
            if not len(ends):
                continue
            count = total[:, ends + 1] - total[:, [i]]
            own, others = count[k], np.delete(count, k, 0)
            most = others.max(0) if len(others) else np.zeros(len(ends), np.int64)
            ok = (seen[k, ends] == 1) & (most <= other_share * (ends - i + 1))
            ahead = [row[q] for q in hits[i][: hits[i].index(p)]]
            ok &= own >= most
            if ahead:
                ok &= own > count[ahead].max(0)
            if owner_share is not None:
                ok &= own >= owner_share * count.sum(0)
            good = np.flatnonzero(ok)
            if len(good) and ends[good[-1]] > best:
                best, owner = int(ends[good[-1]]), p
        if owner is None:
            i += 1
        else:
            out.append((frames[i], frames[best], owner))
            i = best + 1
    return out


def possession_segments(rows: DataFrame, fps: float, cfg: Config = DEFAULT, strict: bool = False) -> DataFrame:
    """Possession intervals of each video from players' ``is_possession``; one video's frames are walked in order."""
    ship(rows.sparkSession)
    half = half_second(fps, cfg.possession_seconds)
    other, owner = (cfg.strict_other_max_share, None) if strict else (cfg.other_max_share, cfg.owner_share)
    held = F.when(F.col("is_possession") & (F.col("player_id") != -1), F.struct("det_idx", "player_id"))
    hits = rows.groupBy("video_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["player_id"]).alias("hits"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        found = segments_of(pdf.frame_id.tolist(), [list(map(int, h)) for h in pdf.hits], half, other, owner)
        return pd.DataFrame([(pdf.video_id.iloc[0], k, *x) for k, x in enumerate(found)], columns=["video_id", "seg_idx", "start_frame", "end_frame", "player_id"])

    return hits.groupBy("video_id").applyInPandas(walk, "video_id long, seg_idx long, start_frame long, end_frame long, player_id long")


def apply_segments(players: DataFrame, segments: DataFrame) -> DataFrame:
    """``is_possession`` anew: true where a segment of that player covers the frame. Segments become frames, so the join has equal keys."""
    at = segments.select("video_id", "player_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_id")).distinct().withColumn("__has", F.lit(True))
    has = F.coalesce("__has", F.lit(False)) & (F.col("player_id") != -1)
    return players.join(at, ["video_id", "player_id", "frame_id"], "left").withColumn("is_possession", has).drop("__has")


def team_near(asked: DataFrame, players: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The team of (video_id, player_id, at): of the nearest frame within the tolerance that knows it, the earlier of two."""
    known = players.where("team_id is not null").select("video_id", "player_id", "frame_id", "det_idx", "team_id")
    key = ["video_id", "player_id", "at"]
    near = band_join(asked.select(*key).distinct(), known, ["video_id", "player_id"], "at", "frame_id", -cfg.team_tolerance, cfg.team_tolerance)
    d = F.col("frame_id") - F.col("at")
    return near.groupBy(*key).agg(F.min_by("team_id", F.struct(F.abs(d), d > 0, F.col("det_idx"))).alias("team_id"))


def passes(segments: DataFrame, players: DataFrame, fps: float, cfg: Config = DEFAULT) -> DataFrame:
    """Consecutive segments of two players of one known team with a short gap."""
    most = max(1, round(cfg.pass_gap_seconds * fps)) if fps > 0 else 1
    w = Window.partitionBy("video_id").orderBy("start_frame", "end_frame")
    nxt = segments.select("video_id", F.col("player_id").alias("from_player"), F.col("end_frame").alias("frame_start"), F.lead("player_id").over(w).alias("to_player"), F.lead("start_frame").over(w).alias("frame_end"))
    gap = F.col("frame_end") - F.col("frame_start") - 1
    pairs = nxt.where((F.col("from_player") != F.col("to_player")) & gap.between(0, most))
    asked = pairs.select("video_id", F.col("from_player").alias("player_id"), F.col("frame_start").alias("at")).unionAll(pairs.select("video_id", "to_player", "frame_end"))
    teams = team_near(asked, players, cfg)
    a = teams.select("video_id", F.col("player_id").alias("from_player"), F.col("at").alias("frame_start"), F.col("team_id").alias("team_from"))
    b = teams.select("video_id", F.col("player_id").alias("to_player"), F.col("at").alias("frame_end"), F.col("team_id").alias("team_to"))
    both = pairs.join(a, ["video_id", "from_player", "frame_start"]).join(b, ["video_id", "to_player", "frame_end"]).where("team_from = team_to")
    return both.select("video_id", "frame_start", "frame_end", "from_player", "to_player", F.col("team_from").alias("team_id"))


def possession(players: DataFrame, balls: DataFrame, fps: float, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Players with final possession, segments and passes."""
    raw = frame_owners(players, balls, cfg)
    segs = possession_segments(raw, fps, cfg)
    return apply_segments(raw, segs), segs, passes(segs, players, fps, cfg)


def shooters(shots: DataFrame, segments: DataFrame, fps: float, cfg: Config = DEFAULT) -> DataFrame:
    """Each shot with the player of the segment whose end is nearest to its start, within an uneven window; the first segment wins ties."""
    back, ahead = int(cfg.shot_back_seconds * fps), int(cfg.shot_forward_seconds * fps)
    near = band_join(shots.select("video_id", "shot_idx", "start_frame"), segments.select("video_id", "seg_idx", "end_frame", "player_id"), ["video_id"], "start_frame", "end_frame", -back, ahead)
    best = top_k(near, ["video_id", "shot_idx"], [F.abs(F.col("start_frame") - F.col("end_frame")), F.col("seg_idx")], 1)
    return shots.join(best.select("video_id", "shot_idx", "player_id"), ["video_id", "shot_idx"], "left")
