"""Medians by buckets are those of all errors, for each video and over all."""

import random
import statistics

from courtflux.operators import court


def test_medians(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(v, rng.choice([0.0, 1.0, rng.uniform(0, 9), 2.0 ** rng.randint(-30, 30)])) for v in (1, 2, None) for _ in range(200 + (v or 0))]
    monkeypatch.setattr(court.F, "median", None)  # it would hold a group's errors at once
    got = {(r.overall, r.video_id): r for r in court.error_summary(spark.createDataFrame(rows, "video_id long, error double")).collect()}
    assert len(got) == 4
    for (overall, v), r in got.items():
        own = [e for k, e in rows if overall or k == v]
        assert r.points == len(own) and r.median == statistics.median(own) and abs(r.mean - statistics.fmean(own)) < 1e-6 * r.mean
