"""Registered queries cover every row of their tables: brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflux.plans.queries import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    spark.range(1, 12 * 130).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 150).alias("o_custkey")).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(0,), (3,)], "n_nationkey long").write.parquet(f"{d}/nation.parquet")
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(4)), [float(x) for x in rng.normal(size=6)]) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, rows


@pytest.mark.parametrize("extra", [[], [(9, None), (9, [0.0] * 6)], [(8, [1.0, 2.0]), (9, [-2.0, -1.0])]])
@pytest.mark.parametrize("block", [50, 2048])
def test_gallery_blocks(spark, small, extra, block):
    from courtflux.functions import vectors as V
    from courtflux.operators import teams

    rows = [*small[1][:200], *((200 + i, *x) for i, x in enumerate(extra))]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {(r.a, r.b): r.least for r in teams.gallery_distances(v, block).collect()}
    pairs = v.selectExpr("label AS a", "embedding AS ea").join(v.selectExpr("label AS b", "embedding AS eb"), F.col("a") < F.col("b"))
    want = {(r.a, r.b): r.least for r in pairs.groupBy("a", "b").agg(F.min(V.cosine_distance(F.col("ea"), F.col("eb"))).alias("least")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_f7_all_vectors(spark, small):
    d, rows = small
    x = {k: np.array([v for _, label, v in rows if label == k], np.float32).astype(float) for k in range(4)}
    x = {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in x.items()}
    got = {(r.a, r.b): r.least for r in QUERIES["f7_gallery_distances"](spark, d).collect()}
    assert len(got) == 6 and all(abs(v - (1 - (x[a] @ x[b].T).max())) < 2e-6 for (a, b), v in got.items())


def test_every_frame(spark, small, monkeypatch):
    d, _ = small
    from courtflux.operators import court, tracking
    from courtflux.plans.derive import Tables
    from courtflux.plans.queries import _homographies

    t = Tables(spark, d)
    slots = court.keypoint_slots(_homographies(t), "nba").select("video_id", "frame_id").distinct().count()
    assert slots > 80 and QUERIES["i14_homographies"](spark, d).count() == slots
    assert QUERIES["d17_annotation_faults"](spark, d).count() == t.det.count()
    assert {tuple(r) for r in QUERIES["a2_nearest_logical"](spark, d).select("video_id", "physical").collect()} == {(v, p) for v in (0, 3) for p in range(90 + 3 * v)}
    near = {tuple(r) for r in QUERIES["e8_team_near"](spark, d).select("video_id", "player_id", "at").collect()}
    players = t.players.toPandas()
    assert near == set(zip(players.video_id, players.player_id, players.frame_id))
    o8 = QUERIES["o8_viewer_counts"](spark, d).first()
    assert o8.mean_players == round(len(players) / 130, 6)
    seen = []
    monkeypatch.setattr(tracking, "track_flow", lambda rows, fps, cfg: seen.append(cfg) or rows.withColumn("player_id", F.lit(0)))
    QUERIES["i2_flow_tracks"](spark, d)
    assert (seen[0].passes, seen[0].max_skip) == (tracking.FlowConfig().passes, tracking.FlowConfig().max_skip)
