"""Frames by event time: any cut into micro-batches, any order, a restart, and the end of idle videos."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from courtflux.operators import ball, tracking
from courtflux.streaming import events
from courtflux.streaming.joblog import JobLog

AT = datetime.datetime(2024, 1, 1)
BALLS = "video_id long, frame_id long, det_idx long, ts timestamp, x double, y double, score double"
PLAYERS = "video_id long, frame_id long, det_idx long, ts timestamp, x1 double, y1 double, x2 double, y2 double, court_x double, court_y double, reid array<double>, color array<double>"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    events.use_rocksdb(spark)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def when(frame):
    return AT + datetime.timedelta(milliseconds=100 * frame)


def far_row(schema, hours=1):
    """A row of another video, so much later that the watermark passes all frames."""
    n = len(schema.split(","))
    return (99, 0, 0, AT + datetime.timedelta(hours=hours), *[None] * (n - 4))


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(q):
    q.processAllAvailable()
    q.stop()


def out_of_order(rows, seed, within=6):
    """Rows moved about, none by more frames than the lateness allows."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[1] + rng.uniform(0, within))


def players():
    rng = random.Random(4)
    rows = []
    for v in (0, 1):
        for f in range(24):
            for k in range(4):
                if rng.random() < 0.1:
                    continue
                x = 60 * k + 3 * f if k % 2 else 400 - 5 * f + 30 * k
                look = [float(k == i) + rng.uniform(0, 0.1) for i in range(4)]
                rows.append((v, f, k, when(f), float(x), 10.0, x + 30.0, 90.0, x / 30 - 7, float(k) - 2, look, None if rng.random() < 0.2 else look[:2]))
    return rows


@pytest.mark.parametrize("cut, seed", [(31, 1), (7, 2)])
def test_court_stream_is_the_batch_tracker(spark, tmp_path, rocks, cut, seed):
    """Filters, vectors and the buffer of late rows live in state columns; the ids are those of the batch tracker."""
    rows = players()
    want = {(r.video_id, r.frame_id, r.det_idx): r.player_id for r in tracking.track_court(spark.createDataFrame(rows, PLAYERS).drop("ts")).collect()}
    mixed = out_of_order(rows, seed)
    size = -(-len(mixed) // (4 if cut > 20 else 6))
    for i in range(0, len(mixed), size):
        put(spark, mixed[i : i + size] + mixed[i : i + 3], PLAYERS, str(tmp_path / "in"))  # some rows come twice
    put(spark, [far_row(PLAYERS)], PLAYERS, str(tmp_path / "in"))
    q = events.court_tracked(stream(spark, str(tmp_path / "in"), PLAYERS), lateness="1 second").writeStream.format("memory").queryName(f"court{cut}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    got = [(r.video_id, r.frame_id, r.det_idx, r.player_id) for r in spark.table(f"court{cut}").collect() if r.video_id != 99]
    assert len(got) == len(rows) and {g[:3]: g[3] for g in got} == want
    assert len(set(want.values())) > 3


def test_restart_from_a_checkpoint(spark, tmp_path, rocks):
    """A stream that stops in the middle and starts again has the rows of one that never stopped."""
    rows = [(v, f, k, when(f), 100.0 + 5 * f + 60 * k, 50.0, 0.5 + (k == f % 2) / 4) for v in (0, 1) for f in range(30) for k in (0, 1)]
    mixed = out_of_order(rows, 5)
    folder, to = str(tmp_path / "in"), str(tmp_path / "out")

    def start():
        return events.gated_balls(stream(spark, folder, BALLS)).writeStream.format("parquet").outputMode("append").option("path", to).option("checkpointLocation", str(tmp_path / "c")).start()

    for part in (mixed[:25], mixed[25:60]):
        put(spark, part, BALLS, folder)
    drain(start())
    early = spark.read.parquet(to).count()
    for part in (mixed[60:], [far_row(BALLS)]):
        put(spark, part, BALLS, folder)
    drain(start())
    got = sorted(map(tuple, spark.read.parquet(to).where("video_id < 99").collect()))
    batch = spark.createDataFrame(rows, BALLS).withColumn("cand_idx", F.col("det_idx").cast("int"))
    assert got == sorted((r.video_id, r.frame_id, r.x, r.y, r.score) for r in ball.gated(batch).collect())
    assert 0 < early < len(got)


# -- the job log ---------------------------------------------------------------------------------------------------------------


def said(job, minute, seq=0, **what):
    return (job, AT + datetime.timedelta(minutes=minute), seq, *(what.get(c) for c in ("status", "video_name", "error")))


LOG = "job_id string, at timestamp, seq long, status string, video_name string, error string"


def state(log):
    return {r.id: (r.status, r.video_name, r.error) for r in log.jobs().collect()}


def test_replayed_batches_change_nothing(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"))
    assert state(log) == {}
    first = spark.createDataFrame([said("a", 0, status="queued", video_name="v"), said("b", 0, status="queued"), said(None, 0, status="x")], LOG)
    second = spark.createDataFrame([said("a", 5, status="processing"), said("a", 5, 1, status="failed", error="e"), said("b", 3, video_name="w")], LOG)
    log.append(first, 0)
    log.append(second, 1)
    want = {"a": ("failed", "v", "e"), "b": ("queued", "w", None)}
    assert state(log) == want
    log.append(first, 0)  # replayed
    log.append(second, 1)
    assert state(log) == want
    log.compact()
    assert state(log) == want and log.snapshot() == 1 and not log._batches()
    log.append(second, 1)  # replayed once more, behind the snapshot
    assert state(log) == want
    log.append(spark.createDataFrame([said("b", 1, status="old"), said("a", 9, status="queued"), said("a", 1, error="older")], LOG), 2)
    assert state(log) == {"a": ("queued", "v", "e"), "b": ("old", "w", None)}
    log.compact()
    assert state(log) == {"a": ("queued", "v", "e"), "b": ("old", "w", None)} and log.snapshot() == 2


def test_a_broken_compaction_is_passed_over(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([said("a", 0, status="queued")], LOG), 0)
    log.compact()
    log.append(spark.createDataFrame([said("a", 1, status="done")], LOG), 1)
    (tmp_path / "log/snapshots/n=2/state").mkdir(parents=True)  # it broke off here
    assert state(log) == {"a": ("done", None, None)} and log.snapshot() == 1


def test_recovery_from_the_log(spark, tmp_path):
    log = JobLog(spark, str(tmp_path / "log"))
    rows = [said(j, 0, status="queued") for j in "abcd"] + [said(j, 1, status="processing") for j in "abc"] + [said("c", 2, status="done")]
    log.append(spark.createDataFrame(rows, LOG), 7)
    files = spark.createDataFrame([("a",), ("c",), ("a",)], "id string")
    for _ in range(2):
        log.recover(files, 0)
        assert state(log) == {"a": ("queued", None, None), "b": ("failed", None, "the file is gone"), "c": ("done", None, None), "d": ("queued", None, None)}


def test_a_stream_into_the_log(spark, tmp_path):
    log, folder = JobLog(spark, str(tmp_path / "log")), str(tmp_path / "in")
    for m in range(3):
        put(spark, [said("a", m, status=f"s{m}")], LOG, folder)
    q = log.sink(stream(spark, folder, LOG), str(tmp_path / "c"), availableNow=True)
    q.awaitTermination()
    assert state(log) == {"a": ("s2", None, None)} and len(log._batches()) == 3
