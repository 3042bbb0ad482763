"""Trackers as a table function in SQL: ``SELECT * FROM track(TABLE(detections), 'court')``.

The function's schema follows its table's: all columns, with player_id set. It asks Spark itself for rows by video in frame order. The
frame-by-frame trackers give out a frame's rows as soon as the next frame begins, so they hold one frame; the flow tracker needs its whole
video. Each name stands for a factory, and callers may register their own beside those here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..runtime import by_value, ship
from .tracking import AppearanceConfig, AppearanceTracker, CourtConfig, CourtTracker, FlowConfig, Video, flow_tracks, seen_of

#: A tracker: called with each frame's rows in order and then with None, it gives pairs (row, player_id) as soon as it knows them.
Tracker = Callable[[list[dict] | None], list[tuple[dict, int]]]


def court() -> Tracker:
    tracker = CourtTracker(CourtConfig())
    return lambda frame: [] if frame is None else list(zip(frame, tracker.step([seen_of(r) for r in frame])))


def appearance() -> Tracker:
    """Rows that no track takes keep their player_id, -1 without one."""
    tracker = AppearanceTracker(AppearanceConfig())

    def step(frame: list[dict] | None) -> list[tuple[dict, int]]:
        if frame is None:
            return []
        own = [-1 if r.get("player_id") is None else r["player_id"] for r in frame]
        return list(zip(frame, tracker.step([seen_of(r) for r in frame], own)))

    return step


def flow(fps: float = 30.0) -> Tracker:
    rows: list[dict] = []

    def step(frame: list[dict] | None) -> list[tuple[dict, int]]:
        if frame is not None:
            rows.extend(frame)
            return []
        ids = np.full(len(rows), -1)
        if rows:
            for k, path in enumerate(flow_tracks(Video(pd.DataFrame(rows)), fps, FlowConfig()), 1):
                ids[path] = k
        return list(zip(rows, ids))

    return step


TRACKERS: dict[str, Callable[[], Tracker]] = {"court": court, "appearance": appearance, "flow": flow}


def register(spark: SparkSession, extra: Mapping[str, Callable[[], Tracker]] | None = None, name: str = "track") -> None:
    """Makes the table function known to the session; ``extra`` are further trackers by name."""
    ship(spark)
    made = TRACKERS | dict(extra or {})

    class Track:
        @staticmethod
        def analyze(rows: AnalyzeArgument, tracker: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument must be a table")
            if tracker.value not in made:
                raise ValueError(f"the second argument must be one of {', '.join(sorted(made))}")
            missing = {"video_id", "frame_id", "det_idx", "x1", "y1", "x2", "y2"} - set(rows.dataType.names)
            if missing:
                raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
            schema = StructType([f for f in rows.dataType.fields if f.name != "player_id"]).add("player_id", LongType())
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn("video_id")], orderBy=[OrderingColumn("frame_id"), OrderingColumn("det_idx")])

        def __init__(self) -> None:
            self.step, self.frame, self.names = None, [], []

        def out(self, found: list[tuple[dict, int]]) -> Iterator[tuple]:
            for row, player in found:
                yield (*(row[n] for n in self.names), int(player))

        def eval(self, row: Row, tracker: str) -> Iterator[tuple]:
            own = row.asDict()
            if self.step is None:
                self.step = made[tracker]()
                self.names = [n for n in own if n != "player_id"]
            if self.frame and self.frame[0]["frame_id"] != own["frame_id"]:
                done, self.frame = self.frame, []
                yield from self.out(self.step(done))
            self.frame.append(own)

        def terminate(self) -> Iterator[tuple]:
            if self.step is not None:
                yield from self.out(self.step(self.frame))
                yield from self.out(self.step(None))

    with by_value():  # the schema is asked for on the driver, by a worker without the package
        spark.udtf.register(name, udtf(Track))
