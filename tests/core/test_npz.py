"""NPZ samples: a round trip with missing parts, files left unread, and jobs that fail."""

import json
import os

import numpy as np
import pytest

from courtflux.sources import npz


def frames(spark, rows):
    return spark.createDataFrame(rows, npz.SCHEMA)


def test_round_trip(spark, tmp_path):
    h = [float(i) for i in range(9)]
    rows = [(f"s{k}.npz", t, h if t % 2 else None, [1.0, 2.0, 3.0, float(t)] if k else None, 0.5 if k else None, None, None) for k in range(5) for t in range(4) if (k, t) != (2, 1)]
    path = str(tmp_path / "set")
    npz.write_samples(frames(spark, rows).repartition(3), path)
    got = {(r.path, r.frame_id): r for r in npz.read_samples(spark, path).collect()}
    assert len(got) == 20 and got["s2.npz", 1].h is None and got["s2.npz", 1].rim is None  # a frame without a row
    for p, t, own, rim, conf, _, _ in rows:
        r = got[p, t]
        assert (r.h, r.rim, r.rim_conf, r.ball, r.ball_conf) == (own, rim, conf, None, None)
    with np.load(f"{path}/s3.npz") as z:
        assert z["homography"].shape == (4, 3, 3) and z["homography_mask"].tolist() == [0, 1, 0, 1] and z["rim_conf"].tolist() == [0.5] * 4
    index = [json.loads(line) for n in os.listdir(path) if n.startswith("index-") for line in open(f"{path}/{n}")]
    assert sorted((x["sample_path"], x["frame_count"]) for x in index) == [(f"s{k}.npz", 4) for k in range(5)]
    assert not [n for n in os.listdir(path) if n.startswith(".")]
    some = npz.read_samples(spark, path, "path like '%s1.npz'")
    assert {r.path for r in some.collect()} == {"s1.npz"}


@pytest.mark.parametrize("bad", ["../x.npz", "x.txt", None])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "set")
    with pytest.raises(Exception):
        npz.write_samples(frames(spark, [(f"s{k}.npz", 0, None, None, None, None, None) for k in range(20)] + [(bad, 0, None, None, None, None, None)]), path)
    assert not [n for n in os.listdir(path) if not n.startswith(".")]
