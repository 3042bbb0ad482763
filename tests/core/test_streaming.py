"""Streams: frames split over micro-batches, late rows, the end of a video, trackers, trails, windows."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from courtflux.operators import ball
from courtflux.streaming import online

SCHEMA = "video_id long, frame_id long, cand_idx int, x double, y double, score double"


def run(spark, tmp_path, name, batches, build, schema=SCHEMA, wait=0.0):
    """The rows of a stream over batches, one micro-batch each."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    if wait:  # a stream with timeouts has always something to do
        until = time.time() + wait
        while time.time() < until and not spark.table(name).count():
            time.sleep(0.3)
    else:
        q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


ROWS = [(v, f, k, 100.0 + 5 * f + 40 * k, 50.0, 0.5 + (k == f % 2) / 4) for v in (0, 1) for f in range(10) for k in (0, 1)]


def test_split_frames(spark, tmp_path):
    """With a frame held, halves of a frame in two batches count as one; the newest frame waits."""
    want = {(r.video_id, r.frame_id, r.x) for r in ball.gated(spark.createDataFrame(ROWS, SCHEMA)).collect() if r.frame_id < 9}
    batches = [ROWS[i : i + 7] for i in range(0, len(ROWS), 7)]
    got = run(spark, tmp_path, "held", batches, lambda s: online.gated_balls(s, hold=1))
    assert {(r.video_id, r.frame_id, r.x) for r in got} == want and len(got) == len(want)


def test_late_rows(spark, tmp_path):
    batches = [[r for r in ROWS if r[1] in (0, 1, 2)], [r for r in ROWS if r[1] == 1], [r for r in ROWS if r[1] == 5]]
    got = run(spark, tmp_path, "late", batches, online.late_rows)
    assert sorted(map(tuple, got)) == [(0, 1, 2), (1, 1, 2)]


def test_idle_videos_end(spark, tmp_path):
    """Frames that wait are handled when nothing comes any more."""
    got = run(spark, tmp_path, "idle", [ROWS], lambda s: online.gated_balls(s, hold=20, idle="1 second"), wait=30)
    assert {r.frame_id for r in got} == set(range(10))


def test_trails(spark, tmp_path):
    rows = [(0, f, 7, float(f), 1.0) for f in range(6)]
    got = run(spark, tmp_path, "trail", [rows[:2], rows[2:]], lambda s: online.trails(s, length=3), "video_id long, frame_id long, player_id long, court_x double, court_y double")
    assert [[p[0] for p in r.trail] for r in sorted(got, key=lambda r: r.frame_id)] == [[0.0], [0, 1.0], [0, 1, 2.0], [1, 2, 3.0], [2, 3, 4.0], [3, 4, 5.0]]


def test_windows_under_a_watermark(spark, tmp_path):
    """A window comes out once events pass its end by the lateness, and events behind the watermark don't count."""
    at = lambda minutes: pd.Timestamp("2024-01-01 00:00:00") + pd.Timedelta(minutes=minutes)
    schema = "ts timestamp, event_type string, value double"
    batches = [[(at(m).to_pydatetime(), "a", 1.0)] for m in (1, 2, 7, 30, 40, 3, 60)]
    got = run(spark, tmp_path, "windows", batches, online.windowed_counts, schema)
    assert {(r.start.minute, r.n) for r in got} == {(0, 2), (5, 1), (30, 1), (40, 1)}


@pytest.mark.parametrize("cut", [1, 3])
def test_tracked(spark, tmp_path, cut):
    """The stream's ids are those of the tracker on all rows."""
    from courtflux.operators import tracking

    rows = [(0, f, k, -1, 100 * k + f, 10, 100 * k + f + 40, 110, [1.0, float(k)], [float(k), 1.0]) for f in range(6) for k in range(3)]
    schema = "video_id long, frame_id long, det_idx long, player_id long, x1 long, y1 long, x2 long, y2 long, color array<double>, reid array<double>"
    df = spark.createDataFrame(rows, schema)
    want = {(r.frame_id, r.det_idx): r.player_id for r in tracking.track_appearance(df).collect()}
    size = len(rows) // cut
    got = run(spark, tmp_path, f"tracked{cut}", [rows[i : i + size] for i in range(0, len(rows), size)], online.tracked, schema)
    assert {(r.frame_id, r.det_idx): r.player_id for r in got} == want
    assert df.select(F.countDistinct("frame_id")).first()[0] == 6
