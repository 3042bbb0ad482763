"""Documents, homographies of segments, evaluation and helpers, by brute force or hand-made results."""

import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflux.functions import geometry as G
from courtflux.functions import text as X
from courtflux.operators import court, metrics
from courtflux.plans import timeline
from courtflux.sources import readers, sinks

PLAYER = "video_id long, frame_id long, det_idx long, player_id long, team_id long, x1 long, y1 long, x2 long, y2 long, confidence double, is_possession boolean, track_number long, number long, number_confidence double, court_x double, court_y double, speed double, vec array<double>, keypoints array<struct<x:double,y:double,c:double>>, polygon array<array<double>>"


def test_document(spark):
    """A whole document, as the viewer reads it."""
    rows = [
        (7, 5, 0, 3, 1, 1, 2, 3, 4, 0.123456, True, 33, 9, 0.98765, 1.23456, -2.0, 3.14159, [1.0, 0.0], [(1.236, 2.0, 0.5)], [[1.26, 2.0]]),
        (7, 5, 1, -1, None, 1, 2, 3, 4, 0.5, True, None, None, None, None, None, None, None, None, None),
        (7, 10, 0, 3, 1, 5, 6, 7, 8, 0.5, None, 33, None, None, None, None, None, [0.0, 1.0], None, None),
        (7, 10, 1, 4, 0, 5, 6, 7, 8, 0.5, False, 44, None, None, None, None, None, [1.0, 1.0], None, None),
    ]
    players = spark.createDataFrame(rows, PLAYER)
    balls = spark.createDataFrame([(7, 10, 0, 0.25, 1, 1, 2, 2)], "video_id long, frame_id long, det_idx long, confidence double, x1 long, y1 long, x2 long, y2 long")
    meta = spark.createDataFrame([(7, 20.0, 100, 50, 12), (8, 25.0, 100, 50, None)], "video_id long, fps double, width int, height int, total_frames long")
    numbers = spark.createDataFrame([(7, 3, 33), (7, 4, 44)], "video_id long, player_id long, track_number long")
    teams = spark.createDataFrame([(7, 3, 1), (7, 4, 0)], "video_id long, player_id long, team_id long")
    passes = spark.createDataFrame([(7, 3, 4, 10, 13, 1)], "video_id long, from_player long, to_player long, frame_start long, frame_end long, team_id long")
    shots = spark.createDataFrame([(7, 2, 9, True, 4, 8, 4), (7, 10, 11, False, None, None, None)], "video_id long, start_frame long, end_frame long, is_make boolean, make_start long, make_end long, player_id long")
    got = {r.video_id: r.document for r in sinks.annotation_documents(meta, players, balls, sinks.pass_rows(passes, numbers, 20.0), sinks.shot_rows(shots, numbers, teams, 20.0), step=5).collect()}
    empty = json.loads(got[8])
    assert empty["frames"] == {} and empty["pass_events"] == [] and empty["shot_events"] == []
    doc = json.loads(got[7])
    assert list(doc) == ["metadata", "frames", "pass_events", "shot_events"] and list(doc["frames"]) == ["0", "5", "10"]
    assert doc["metadata"] == {"fps": 20.0, "width": 100, "height": 50, "total_frames": 12, "frame_step": 5}
    assert doc["frames"]["0"] == {"players": [], "balls": [], "reid_cross_frame_matrix": None}
    first, lost = doc["frames"]["5"]["players"]
    assert first == {
        "player_id": 3, "raw_player_id": 3, "team_id": 1, "bbox": [1, 2, 3, 4], "confidence": 0.1235, "jersey_number": 9, "jersey_confidence": 0.9876, "court_position": [1.235, -2.0],
        "speed": 3.1416, "skeleton": [[1.24, 2.0, 0.5]], "mask_polygon": [[1.3, 2.0]], "is_possession": True, "track_number": 33,
    }
    assert (lost["player_id"], lost["is_possession"], lost["team_id"], lost["court_position"]) == (-1, False, None, None)
    assert doc["frames"]["10"]["balls"] == [{"bbox": [1, 1, 2, 2], "confidence": 0.25}] and doc["frames"]["10"]["players"][0]["is_possession"] is False
    assert doc["frames"]["10"]["reid_cross_frame_matrix"] == {"row_ids": [3], "col_ids": [3, 4], "distances": [[1.0, 0.2929]]}
    assert doc["pass_events"] == [{"frame_start": 10, "frame_end": 13, "from_player_id": 3, "to_player_id": 4, "from_track_number": 33, "to_track_number": 44, "team_id": 1, "timestamp_sec": 0.65}]
    make, miss = doc["shot_events"]
    assert (make["timestamp_start_sec"], make["timestamp_end_sec"], make["shooter_player_id"], make["shooter_track_number"], make["shooter_team_id"], make["make_timestamp_start_sec"], make["make_timestamp_end_sec"]) == (0.1, 0.45, 4, 44, 0, 0.2, 0.4)
    assert miss["shooter_player_id"] is None and miss["make_start"] is None and miss["make_timestamp_end_sec"] is None and not miss["is_make"]


def _points(h, rng, n=12):
    src = rng.random((n, 2))
    return [(float(x), float(y), float(u), float(v)) for (x, y), (u, v) in zip(src, court.apply(h, src))]


def test_baseline_homography(spark):
    """Outliers don't matter, and few points give none."""
    rng = np.random.default_rng(3)
    h = np.array([[1.1, 0.02, -0.4], [0.01, 0.9, -0.45], [0.01, 0.03, 1.0]])
    rows = [(0, 0, *p) for p in _points(h, rng, 14)] + [(0, 0, 0.5, 0.5, 9.0, 9.0), (0, 0, 0.1, 0.9, -7.0, 3.0)] + [(0, 1, *p) for p in _points(h, rng, 3)]
    got = {r.frame_id: r.h for r in court.least_squares(spark.createDataFrame(rows, "video_id long, frame_id long, sx double, sy double, dx double, dy double")).collect()}
    assert np.allclose(np.array(got[0]).reshape(3, 3), h, atol=1e-8) and got[1] is None


def test_matches_at_all_limits_are_those_of_each(spark):
    rng = np.random.default_rng(5)
    box = lambda n: [(0, int(f), i, int(x), int(y), int(x + w), int(y + 40), float(c)) for i, (f, x, y, w, c) in enumerate(zip(rng.integers(0, 6, n), rng.integers(0, 60, n), rng.integers(0, 20, n), rng.integers(20, 50, n), np.round(rng.random(n), 1)))]
    schema = "video_id long, frame_id long, det_idx long, x1 long, y1 long, x2 long, y2 long, confidence double"
    gt, pred = spark.createDataFrame(box(40), schema), spark.createDataFrame(box(60), schema)
    rows = metrics.matched(gt, pred, metrics.IOUS).collect()
    for t in (0.5, 0.75, 0.95):
        free = {(r.frame_id, r.det_idx): (r.x1, r.y1, r.x2, r.y2) for r in gt.collect()}
        want = {}
        for p in sorted(pred.collect(), key=lambda r: (r.frame_id, -r.confidence, r.det_idx)):
            def iou(b):
                w, h = min(p.x2, b[2]) - max(p.x1, b[0]), min(p.y2, b[3]) - max(p.y1, b[1])
                both = max(w, 0) * max(h, 0)
                return both / ((p.x2 - p.x1) * (p.y2 - p.y1) + (b[2] - b[0]) * (b[3] - b[1]) - both)

            near = sorted(((-iou(b), k) for k, b in free.items() if k[0] == p.frame_id))
            hit = near[0][1] if near and -near[0][0] >= t else None
            want[p.det_idx] = None if hit is None else hit[1]
            free.pop(hit, None)
        assert {r.det_idx: r.gt_idx for r in rows if r.iou == t} == want


def test_gallery_ranks(spark):
    """Blocks of any size give the ranks of one sorted list."""
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.integers(0, 3, 3)]) for i in range(90)]
    g = spark.createDataFrame(rows, "id long, pid long, v array<double>")
    want = {}
    for i, p, v in rows[::9]:
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j, q) for j, q, w in rows if j != i)
        want |= {(i, j): k for k, (_, j, q) in enumerate(order, 1) if q == p}
    for block in (7, 4096):
        got = {(r.q, r.g): r["rank"] for r in metrics.reid_ranks(g.where("id % 9 = 0"), g, block).collect()}
        assert got == want


def test_segments_of_lines(spark):
    row = spark.range(1).select(
        G.crop_segment(F.lit(0), F.lit(0), F.lit(10), F.lit(20), F.lit(2), F.lit(5)).alias("a"), G.crop_segment(F.lit(0), F.lit(0), F.lit(10), F.lit(20), F.lit(12), F.lit(15)).alias("b"),
        G.crop_segment(F.lit(3), F.lit(1), F.lit(3), F.lit(9), F.lit(2), F.lit(5)).alias("c"), G.extend_segment(F.lit(0), F.lit(0), F.lit(3), F.lit(4), 5.0).alias("d"), G.extend_segment(F.lit(1), F.lit(1), F.lit(1), F.lit(1), 5.0).alias("e"),
    ).first()
    assert tuple(row.a) == (2, 4, 5, 10) and row.b is None and tuple(row.c) == (3, 1, 3, 9) and np.allclose(tuple(row.d), (-3, -4, 6, 8)) and tuple(row.e) == (1, 1, 1, 1)


def test_names_and_places(spark):
    df = spark.createDataFrame([("/a/b é?.mp4",), ("",), ("x/",)], "n string")
    assert [r.f for r in df.select(X.file_name(F.col("n")).alias("f")).collect()] == ["b é_.mp4", "video.mp4", "video.mp4"]
    got = timeline.placed(spark.range(100).repartition(7).orderBy(F.desc("id")))
    assert {r.id: r.place for r in got.collect()} == {i: 99 - i for i in range(100)}
    big = spark.range(0, 200_000, 7).selectExpr("id", "10 + id % 5 AS width", "20L AS height")
    kept = readers.large_enough(big, "id", 12).orderBy("id").collect()
    assert [r["index"] for r in kept] == list(range(len(kept))) and min(r.width for r in kept) == 12
    text = spark.createDataFrame([("Ünï",), (None,), ("plain",)], "t string").select(X.ascii_only(F.col("t")).alias("a")).collect()
    assert [r.a for r in text] == ["Uni", None, "plain"]


def test_overall_rows_tell_themselves_from_null_labels(spark):
    rows = spark.createDataFrame([(None, None), (1, 1), (1, 2)], "label int, pred int")
    got = {(r.label, r.overall): r.n for r in metrics.class_accuracy(rows).collect()}
    assert got == {(None, False): 1, (1, False): 2, (None, True): 3}


@pytest.mark.parametrize("gone", ["ahocorasick", "courtflux.llm", "xxhash"])
def test_entry_without_optional_parts(gone):
    """The library's own queries stay when the optional subpackage, or a library that only it needs, can't be imported."""
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'op10_simhash' not in q and 'd2_nms' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True)
