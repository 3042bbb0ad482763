"""Frames by event time: typed state, timers as the buffer that puts late rows in order, and a court tracker whose filters are state columns.

A video's rows wait in a list state until the watermark passes their frame's time; one timer, at the earliest of them, then hands over whole frames,
in order of time, and is set anew for those that wait on. Each access to state is a call to the JVM, so there are a few a video and micro-batch, and
waiting rows go there by parts of many, each part's columns in Arrow's stream format, as a row by itself takes longer than its tracking. So results don't depend on how rows are cut into micro-batches, on their order, or on rows that come twice (of
one (frame_id, det_idx) the last counts). Rows behind the watermark are dropped by Spark. A video's state goes once the watermark is ``idle``
past its last frame. State lives in RocksDB (``use_rocksdb``), so it is not bounded by an executor's memory, and its columns (of waiting rows the
packed parts) can be read with the state data source. The watermark is the stream's: a video whose clock is far behind others' loses rows.

Defined results: rows without a time never come out; a frame's time is that of its earliest row. Null numbers and vectors are as in the batch
operators. They are for streams: on a batch DataFrame no time passes, and nothing comes out. ``replayed`` runs one over a table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ball import gate
from ..operators.tracking import CourtConfig, CourtTracker, seen_of
from ..runtime import by_value, scratch, written

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need; set it before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


#: Rows of a packed part.
PART = 10_000
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def packed(columns: list[list], types: list[str]) -> list[tuple[bytes]]:
    """Columns of plain values as parts of rows that one binary state column takes."""
    schema, parts = pa.schema([(str(i), _ARROW[t]) for i, t in enumerate(types)]), []
    for k in range(0, len(columns[0]), PART):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_batch(pa.record_batch([pa.array(c[k : k + PART], _ARROW[t]) for c, t in zip(columns, types)], schema=schema))
        parts.append((sink.getvalue().to_pybytes(),))
    return parts


def unpacked(parts: Iterator[tuple[bytes]]) -> Iterator[tuple]:
    """The rows of packed parts, in their order."""
    for (part,) in parts:
        yield from zip(*(c.to_pylist() for c in pa.ipc.open_stream(part).read_all().columns))


def _plain(x):
    """A value of a pandas row as packed parts take it."""
    if x is None or x is pd.NaT or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return None
    if isinstance(x, (np.ndarray, list, tuple)):
        return np.asarray(x, float)
    return x.item() if isinstance(x, np.generic) else x


def replayed(rows: DataFrame, build: Callable[[DataFrame], DataFrame], end: DataFrame, files: int = 4) -> DataFrame:
    """What the stream that ``build`` makes gives for a table: its rows by ranges of time, a range a write, in micro-batches of few files, then those of ``end``.

    ``end`` has the table's columns and times that let the watermark pass all frames that are to come out.
    """
    spark, key = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    folder, out, before = scratch(spark), scratch(spark), spark.conf.get(key, None)
    rows = written(rows)
    each = rows.rdd.getNumPartitions()
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - F.lit(first)) * files / F.lit((last or 0) - (first or 0) + 1))
    for k in range(files):  # one after another, as a file's age decides when it is read
        rows.where(part == k).write.mode("append").parquet(folder)
    schema = rows.schema
    use_rocksdb(spark)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(folder)
        options = {"path": out, "checkpointLocation": scratch(spark)}
        q = build(stream).writeStream.format("parquet").outputMode("append").options(**options).trigger(availableNow=True).start()
        q.awaitTermination()
        end.coalesce(1).write.mode("append").parquet(folder)
        q = build(stream).writeStream.format("parquet").outputMode("append").options(**options).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.parquet(out)


class Frames(StatefulProcessor):
    """Hands over each frame's rows, in order, when the watermark passes it. Subclasses say which columns wait and what a frame gives."""

    #: The columns that wait, besides the keys and the time.
    columns: dict[str, str] = {}
    #: Names of what ``frame`` gives, behind video_id and frame_id.
    gives: list[str] = []

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.types = ["long", "long", "long", *self.columns.values()]  # frame_id, det_idx, the time, and the columns
        self.waiting = handle.getListState("waiting", "rows binary")
        self.done = handle.getValueState("done", "frame_at long, last_at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def frame(self, rows: list[dict]) -> list[tuple]:
        raise NotImplementedError

    def frames(self, each: list[list[dict]]) -> list[list[tuple]]:
        """What the frames give that are handed over at once, in order."""
        return [self.frame(rows) for rows in each]

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, last = self.done.get() if self.done.exists() else (-1, -1)
        waits, times = [], set()
        for part in rows:
            part = part[part.ts.notna()]
            at = (part.ts.to_numpy("datetime64[us]").astype("int64") // 1000).tolist()
            for t, f, d, *values in zip(at, part.frame_id.tolist(), part.det_idx.tolist(), *(part[n] for n in self.columns)):
                if t > before:  # frames that were handed over are closed
                    waits.append((int(f), int(d), t, *map(_plain, values)))
                    times.add(t)
        if times:
            self.waiting.appendList(packed(list(zip(*waits)), self.types))
            self.handle.registerTimer(min(times))
            self.done.update((before, max(last, *times)))
            self.handle.registerTimer(max(last, *times) + self.idle_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        before, last = self.done.get() if self.done.exists() else (-1, -1)
        if expiredTimerInfo.getExpiryTimeInMs() <= before and now < last + self.idle_ms:
            return  # the frames up to the watermark were handed over by an earlier timer
        held = {(f, d): (f, d, at, *values) for f, d, at, *values in unpacked(self.waiting.get())}  # of rows that come twice the last
        ready: dict[int, list[dict]] = {}
        for f, d, at, *values in held.values():
            if at <= now:
                ready.setdefault(f, []).append({"frame_id": f, "det_idx": d, "at": at} | dict(zip(self.columns, values)))
        order = sorted(ready, key=lambda f: (min(r["at"] for r in ready[f]), f))
        each = [sorted(ready[f], key=lambda r: r["det_idx"]) for f in order]
        out = [(key[0], f, *x) for f, got in zip(order, self.frames(each)) for x in got]
        if ready:
            before = max(before, *(r["at"] for rows in each for r in rows))
            rest = [row for row in held.values() if row[2] > now]
            if rest:
                self.waiting.put(packed(list(zip(*rest)), self.types))
                self.handle.registerTimer(min(row[2] for row in rest))
            else:
                self.waiting.clear()
        if now >= last + self.idle_ms:
            self.forget()
            self.done.clear()
        elif ready:
            self.done.update((before, last))
        yield pd.DataFrame(out, columns=["video_id", "frame_id", *self.gives])

    def close(self) -> None:
        pass


class BallGate(Frames):
    columns = {"x": "double", "y": "double", "score": "double"}
    gives = ["x", "y", "score"]

    def __init__(self, idle_ms: int, most: float):
        super().__init__(idle_ms)
        self.most = most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "x double, y double")

    def frames(self, each: list[list[dict]]) -> list[list[tuple]]:
        last, out = tuple(self.last.get()) if each and self.last.exists() else None, []
        for rows in each:
            got = gate(((r["x"], r["y"], r["score"]) for r in rows), last, self.most)
            last = last if got is None else (float(got[0]), float(got[1]))
            out.append([] if got is None else [tuple(map(float, got))])
        if any(out):
            self.last.update(last)
        return out

    def forget(self) -> None:
        self.last.clear()


_FILTER = "hits long, age long, sure boolean, mean array<double>, cov array<double>, bottom double, height double"


class CourtPlayers(Frames):
    """The court tracker: an entry a row of its arrays, and a list of recent vectors a row and kind."""

    columns = {"x1": "double", "y1": "double", "x2": "double", "y2": "double", "court_x": "double", "court_y": "double", "reid": "array<double>", "color": "array<double>", "has_mask": "boolean"}
    gives = ["det_idx", "player_id"]

    def __init__(self, idle_ms: int, cfg: CourtConfig):
        super().__init__(idle_ms)
        self.cfg = cfg

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "id long")
        self.filters = handle.getMapState("filters", "id long", _FILTER)
        self.looks = handle.getMapState("looks", "id long, kind int", "vectors array<array<double>>")

    def _load(self) -> CourtTracker:
        """The tracker as it was after the last frame that was handed over; its rows are in order of ids."""
        t = CourtTracker(self.cfg)
        rows = sorted((k[0], *v) for k, v in self.filters.iterator())
        if self.next.exists():
            t.next = int(self.next.get()[0])
        if rows:
            ids, hits, age, sure, mean, cov, bottom, height = zip(*rows)
            t.id, t.hits, t.age, t.sure = np.array(ids, int), np.array(hits, int), np.array(age, int), np.array(sure, bool)
            t.mean, t.cov = np.array(mean, float), np.array(cov, float).reshape(-1, 4, 4)
            t.bottom, t.height = np.array(bottom, float), np.array(height, float)
            held = {tuple(k): v[0] for k, v in self.looks.iterator()}
            t.looks = [tuple(deque((np.array(x, float) for x in held.get((i, kind), ())), maxlen=self.cfg.gallery) for kind in (0, 1)) for i in ids]
        return t

    def _save(self, t: CourtTracker, gone: set[int]) -> None:
        self.next.update((int(t.next),))
        for i in gone - set(t.id.tolist()):
            self.filters.removeKey((i,))
            for kind in (0, 1):
                if self.looks.containsKey((i, kind)):
                    self.looks.removeKey((i, kind))
        for i, *row, looks in zip(t.id.tolist(), t.hits.tolist(), t.age.tolist(), t.sure.tolist(), t.mean.tolist(), t.cov.reshape(len(t.cov), 16).tolist(), t.bottom.tolist(), t.height.tolist(), t.looks):
            self.filters.updateValue((i,), tuple(row))
            for kind in (0, 1):
                if looks[kind]:
                    self.looks.updateValue((i, kind), ([x.tolist() for x in looks[kind]],))

    def frames(self, each: list[list[dict]]) -> list[list[tuple]]:
        """The state is read before the first of them and written after the last, not for each."""
        if not each:
            return []
        tracker = self._load()
        had, out = set(tracker.id.tolist()), []
        for rows in each:
            ids = tracker.step([seen_of(r) for r in rows])
            out.append([(r["det_idx"], int(i)) for r, i in zip(rows, ids)])
        self._save(tracker, had)
        return out

    def forget(self) -> None:
        self.next.clear()
        self.filters.clear()
        self.looks.clear()


def _by_video(stream: DataFrame, frames: Frames, schema: str, lateness: str) -> DataFrame:
    some = stream.select("video_id", "frame_id", "det_idx", "ts", *(F.col(n).cast(t).alias(n) if n in stream.columns else F.lit(None).cast(t).alias(n) for n, t in frames.columns.items()))
    grouped = some.withWatermark("ts", lateness).groupBy("video_id")
    # Spark also asks the processor for its state's columns in a driver's worker, which doesn't have the shipped package: it gets the code itself.
    with by_value():
        return grouped.transformWithStateInPandas(frames, f"video_id long, frame_id long, {schema}", "append", "eventTime")


def court_tracked(stream: DataFrame, cfg: CourtConfig = CourtConfig(), lateness: str = "1 second", idle_ms: int = 60_000) -> DataFrame:
    """video_id, frame_id, det_idx and player_id of a stream of detections (.., ts, x1..y2, court_x, court_y, reid, color, has_mask), as ``track_court`` gives them.

    Columns that the stream lacks count as null.
    """
    return _by_video(stream, CourtPlayers(idle_ms, cfg), "det_idx long, player_id long", lateness)


def gated_balls(stream: DataFrame, most: float = 300.0, lateness: str = "1 second", idle_ms: int = 60_000) -> DataFrame:
    """video_id, frame_id, x, y and score of each frame's accepted ball in a stream of candidates (.., det_idx, ts, x, y, score)."""
    return _by_video(stream, BallGate(idle_ms, most), "x double, y double, score double", lateness)
