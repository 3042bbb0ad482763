"""Plans that don't gather what grows: pairs of galleries by equal keys, precision curves of tied confidences."""

import numpy as np

from courtflux.operators import metrics, teams
from courtflux.runtime import written


def test_gallery_distances_in_blocks(spark):
    """Blocks of any size give the least distances of all pairs; no nested loop and no cartesian product."""
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 5)), [float(x) for x in rng.normal(0, 1, 3)]) for i in range(60)] + [(60, None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {}
    for i, a, _ in rows:
        for j, b, _ in rows:
            if None not in (a, b) and a < b:
                want[a, b] = min(want.get((a, b), 9.0), 1 - float(unit[i] @ unit[j]))
    for block in (4, 2048):
        got = teams.gallery_distances(df, block)
        assert {(r.a, r.b): round(r.least, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tied_confidences(spark, monkeypatch):
    """With all confidences equal the curve follows frames, and no range holds all rows."""
    rng = np.random.default_rng(2)
    rows = [(v, f, k, 1.0, bool(rng.random() < 0.6)) for v in range(3) for f in range(100) for k in range(4)]
    m = spark.createDataFrame(rows, "video_id long, frame_id long, det_idx long, confidence double, hit boolean").repartition(3)
    got = sorted(((r.video_id, r.frame_id, r.det_idx), r.precision, r.recall) for r in metrics.precision_curve(m, 900).collect())
    tp = 0
    for n, ((v, f, k, _, hit), (key, precision, recall)) in enumerate(zip(rows, got), 1):
        tp += hit
        assert key == (v, f, k) and np.isclose(precision, tp / n) and np.isclose(recall, tp / 900)
    ranges = []
    monkeypatch.setattr(metrics, "written", lambda df: ranges.append(written(df)) or ranges[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        metrics.precision_curve(m, 900)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranges[0].groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < len(rows) / 2
