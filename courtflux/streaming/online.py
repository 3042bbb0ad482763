"""Frame-ordered state on Structured Streaming: the ball gate, the appearance tracker, trails, and windowed counts.

State is keyed by video and lives in Spark's state store. Within a micro-batch a video's frames are put in order. With ``hold`` the newest
frames of a video wait in its state, so that a frame whose rows come in two micro-batches, or a little late, is handled whole; without it
a frame is handled with the rows that its first micro-batch has. Rows of frames that were handled already come too late, and ``late_rows``
lists them. ``idle`` ends a video: if no row comes for that time, the frames that wait are handled, and its state goes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ball import gate
from ..operators.tracking import AppearanceConfig, AppearanceTracker, seen_of
from ..runtime import ship


def _milliseconds(idle: str) -> int:
    amount, unit = idle.split()
    return int(float(amount) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def _stateful(stream: DataFrame, schema: str, step, fresh, hold: int = 0, idle: str | None = None, late=None) -> DataFrame:
    """Runs ``step(state, rows) -> output rows`` over each video's frames in order; state and waiting rows are pickled between batches.

    ``late(frame_id, rows) -> output rows`` is asked for rows that come too late, which otherwise leave none.
    """
    ship(stream.sparkSession)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    wait = _milliseconds(idle) if idle else None

    def run(key: tuple, parts: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting, state = (store.get[0], pickle.loads(store.get[1]), pickle.loads(store.get[2])) if store.exists else (-1, None, fresh())
        over = wait is not None and store.hasTimedOut
        some = [x for x in ([waiting] if waiting is not None else []) + ([] if over else list(parts)) if len(x)]
        out, rest = [], None
        if some:
            rows = pd.concat(some, ignore_index=True)
            if late is not None:
                out += [(key[0], int(f), *x) for f, own in rows[rows.frame_id <= last].groupby("frame_id", sort=True) for x in late(int(f), own)]
            rows = rows[rows.frame_id > last]
            frames = sorted(rows.frame_id.unique())
            ready = frames if over else frames[: len(frames) - hold]
            by = dict(list(rows.groupby("frame_id")))
            for frame in ready:
                last = int(frame)
                out += [(key[0], last, *x) for x in step(state, by[frame])]
            rest = rows[rows.frame_id > last]
        if over:
            store.remove()
        else:
            store.update((last, pickle.dumps(rest if rest is not None and len(rest) else None), pickle.dumps(state)))
            if wait is not None:
                store.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait is not None else GroupStateTimeout.NoTimeout
    return stream.groupBy("video_id").applyInPandasWithState(run, schema, "last long, waiting binary, state binary", "append", timeout)


def late_rows(stream: DataFrame, hold: int = 0, idle: str | None = None) -> DataFrame:
    """How many rows of a frame (n) came after the frame was handled."""
    return _stateful(stream, "video_id long, frame_id long, n long", lambda state, rows: [], dict, hold, idle, lambda frame, rows: [(len(rows),)])


def gated_balls(candidates: DataFrame, most: float = 300.0, hold: int = 0, idle: str | None = None) -> DataFrame:
    """The accepted ball of each frame of a stream of candidates (video_id, frame_id, cand_idx, x, y, score)."""

    def step(state: dict, rows: pd.DataFrame) -> list[tuple]:
        got = gate(rows.sort_values("cand_idx")[["x", "y", "score"]].itertuples(index=False, name=None), state.get("last"), most)
        if got is None:
            return []
        state["last"] = got[:2]
        return [tuple(map(float, got))]

    return _stateful(candidates, "video_id long, frame_id long, x double, y double, score double", step, dict, hold, idle)


def tracked(rows: DataFrame, cfg: AppearanceConfig = AppearanceConfig(), hold: int = 0, idle: str | None = None) -> DataFrame:
    """Ids by the appearance tracker for a stream of detections (video_id, frame_id, det_idx, player_id, x1..y2, vectors)."""

    def step(tracker: AppearanceTracker, some: pd.DataFrame) -> list[tuple]:
        some = some.sort_values("det_idx")
        ids = tracker.step([seen_of(r) for r in some.to_dict("records")], some.player_id.tolist())
        return list(zip(some.det_idx.tolist(), map(int, ids)))

    return _stateful(rows, "video_id long, frame_id long, det_idx long, player_id long", step, lambda: AppearanceTracker(cfg), hold, idle)


def trails(rows: DataFrame, length: int = 30, hold: int = 0, idle: str | None = None) -> DataFrame:
    """The last positions of each player, as they come (player_id, court_x, court_y)."""

    def step(state: dict, some: pd.DataFrame) -> list[tuple]:
        out = []
        for r in some.itertuples(index=False):
            own = state.setdefault(int(r.player_id), [])
            own.append((float(r.court_x), float(r.court_y)))
            del own[:-length]
            out.append((int(r.player_id), [list(p) for p in own]))
        return out

    return _stateful(rows, "video_id long, frame_id long, player_id long, trail array<array<double>>", step, dict, hold, idle)


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling or sliding windows under a watermark."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", lateness).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Counts of each user's events by sessions."""
    s = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")


