"""The scenes' branches are taken: without occlusion links, off-screen links, vectors or splits the truth is missed."""

import os

import pytest
from pyspark.sql import functions as F

from courtflux.operators import stitch, tracking
from courtflux.plans import scenes
from courtflux.plans.catalog import ORACLE, QUERIES
from courtflux.plans.derive import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def scene(spark):
    return scenes._scene(Tables(spark, FOLDER)).where("video_id = 0").cache()


def tracked(rows, cfg):
    return tracking.track_flow(rows, 30.0, cfg)


def ids(rows, where):
    return {r.player_id for r in rows.where(where).select("player_id").distinct().collect()}


def test_links_of_the_flow(scene):
    whole = tracked(scene, tracking.FlowConfig(tracks=8)).cache()
    assert ids(whole, "truth = 4") == ids(whole, "truth = 4 and frame_id < 40") and len(ids(whole, "truth = 4")) == 1
    assert len(ids(whole, "truth = 5")) == 1 and ids(whole, "truth = 6 and frame_id > 60") == {-1}
    assert ids(tracked(scene, tracking.FlowConfig(tracks=8, occlusion_from=99)), "truth = 4 and frame_id > 60") == {-1}  # no link behind a player
    without = tracked(scene, tracking.FlowConfig(tracks=8, margin=-1.0))  # no link off the picture
    assert ids(without, "truth = 5 and frame_id < 40") != ids(without, "truth = 5 and frame_id > 60")


def test_a_split_is_needed(scene):
    mixed = F.expr("CASE WHEN frame_id >= 50 AND truth IN (7, 8) THEN 15 - truth ELSE truth END").cast("long")
    rows = scene.withColumn("player_id", mixed)
    one = lambda cfg: stitch.stitch(rows, 30.0, cfg).where("truth IN (7, 8)").groupBy("truth").agg(F.countDistinct("player_id").alias("n")).collect()
    assert {r.n for r in one(stitch.StitchConfig(players=8))} == {1} and {r.n for r in one(stitch.StitchConfig(players=8, split_at=9.0))} == {2}


def test_scenes_have_sql():
    assert {n for n in QUERIES if n.endswith("_scene")} <= set(ORACLE)
