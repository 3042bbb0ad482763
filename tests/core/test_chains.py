"""Chains against plain products, reference frames against all pairs, pooled homographies block by block and whole, spans of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflux.operators import chains, court
from courtflux.operators.relops import overlapping, points_in_spans

FRAMES = "video_id long, frame_id long, step array<double>"


def steps_of(seed, n, missing=(), bend=0.01):
    rng = np.random.default_rng(seed)
    return [None if i in missing else np.eye(3) + bend * rng.normal(0, 1, (3, 3)) * [[1, 1, 3], [1, 1, 3], [0.2, 0.2, 0]] for i in range(n)]


def frames_of(spark, steps, video=0, at=None):
    at = at or range(len(steps))
    return spark.createDataFrame([(video, int(f), None if s is None else s.ravel().tolist()) for f, s in zip(at, steps)], FRAMES)


@pytest.mark.parametrize("carry, left, block", [(True, True, 5), (False, True, 2), (True, False, 64), (False, False, 5)])
def test_chains_are_products(spark, carry, left, block):
    """With blocks of blocks, gaps between frames, missing steps and two videos."""
    want, parts = {}, []
    for v, (n, missing, at) in enumerate([(37, {0, 9, 30}, None), (11, set(), [0, 1, 2, 50, 51, 90, 300, 301, 302, 303, 900]), (1, {0}, None)]):
        steps = steps_of(v, n, missing)
        parts.append(frames_of(spark, steps, v, at))
        now = np.eye(3)
        for k, (f, s) in enumerate(zip(at or range(n), steps)):
            if k and (s is not None or not carry):
                now = None if s is None or now is None else s @ now if left else now @ s
            want[v, f] = now
    frames = parts[0].unionAll(parts[1]).unionAll(parts[2]).repartition(3)
    got = {(r.video_id, r.frame_id): r.m for r in chains.chains(frames, carry, left, block).collect()}
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert (got[k] is None) == (m is None) and (m is None or np.allclose(got[k], m.ravel(), atol=1e-9)), k


def test_to_reference(spark):
    frames = frames_of(spark, steps_of(3, 20, {7}))
    for left in (True, False):
        chain = {r.frame_id: np.array(r.m).reshape(3, 3) for r in chains.chains(frames, True, left, 4).collect()}
        got = chains.to_reference(chains.chains(frames, True, left, 4), spark.createDataFrame([(0, 12)], "video_id long, ref long"), left)
        for r in got.collect():
            inv = np.linalg.inv(chain[12])
            assert np.allclose(np.array(r.m).reshape(3, 3), chain[r.frame_id] @ inv if left else inv @ chain[r.frame_id], atol=1e-8)


def nearest_reference(steps, width, height):
    """The frame with the nearest farthest centre, over all pairs."""
    c, now, chain = np.array([width / 2, height / 2, 1.0]), np.eye(3), [np.eye(3)]
    for s in steps[1:]:
        if s is None:
            break
        now = now @ s
        chain.append(now)
    best = []
    for r, m in enumerate(chain):
        q = np.array([m @ np.linalg.inv(k) @ c for k in chain])
        best.append((float(np.hypot(*(q[:, :2] / q[:, 2:] - c[:2]).T).max()), r))
    return min(best)


@pytest.mark.parametrize("seed, bend", [(2, 0.05), (4, 0.3)])
def test_reference_frames(spark, seed, bend):
    """Also where horizons cut the hull of the centres, so that all of them are looked at."""
    steps = steps_of(seed, 45, {40}, bend)
    got = chains.reference_frames(frames_of(spark, steps).unionAll(frames_of(spark, steps[:1], 5)), 2.0, 1.0, 8).collect()
    want = nearest_reference(steps, 2.0, 1.0)
    row = next(r for r in got if r.video_id == 0)
    assert row.ref == want[1] and np.isclose(row.farthest, want[0], rtol=1e-6)
    assert next((r.ref, r.farthest) for r in got if r.video_id == 5) == (0, 0.0)


def test_hull():
    p = np.random.default_rng(0).normal(0, 1, (500, 2))
    h = chains.hull(p)
    for a in np.linspace(0, 6, 50):
        d = np.array([np.cos(a), np.sin(a)])
        assert np.isclose((h @ d).max(), (p @ d).max())
    assert len(chains.hull(np.array([[1.0, 2.0]] * 3))) == 1


BASE = np.array([[1.1, 0.02, -0.4], [0.01, 0.9, -0.45], [0.05, 0.03, 1.0]])
STEP = np.array([[1, 0, 0.01], [0, 1, -0.02], [0, 0, 1.0]])


def scene(spark, n, each=3, wrong=2, own=True, seed=5):
    """Frames of a moving picture with a few right and wrong points each; a frame's own homography is missing or wrong."""
    rng = np.random.default_rng(seed)
    true, pts, frames = BASE, [], []
    for t in range(n):
        if t:
            true = true @ np.linalg.inv(STEP)
        src = rng.random((each + wrong, 2))
        dst = court.apply(true, src)
        dst[each:] += rng.uniform(0.3, 0.9, (wrong, 2))
        pts += [(0, t, *map(float, (*s, *d))) for s, d in zip(src, dst)]
        frames.append((0, t, np.eye(3).ravel().tolist() if own and t % 2 else None, STEP.ravel().tolist()))
    f = spark.createDataFrame(frames, "video_id long, frame_id long, h array<double>, step array<double>")
    p = spark.createDataFrame(pts, "video_id long, frame_id long, sx double, sy double, dx double, dy double")
    truth, h = [], BASE
    for t in range(n):
        truth.append(h / h[2, 2])
        h = h @ np.linalg.inv(STEP)
    return f, p, truth


@pytest.mark.parametrize("block", [8, 64])
def test_pooled_segments(spark, block):
    """No frame's points are enough for it, those of a segment are; in one call, or by rounds over small blocks, to the same end."""
    f, p, truth = scene(spark, 24)
    got = {r.frame_id: np.array(r.h).reshape(3, 3) for r in chains.replace_segments(f, p, block=block).collect()}
    assert len(got) == 24 and all(np.allclose(got[t], truth[t], atol=1e-6) for t in range(24))


def test_right_homographies_stay(spark):
    """Right ones are as good as any pooled one, and frames without points or homographies do no harm."""
    f, p, truth = scene(spark, 9, each=6, wrong=0)
    own = spark.createDataFrame([(0, t, None if t == 4 else h.ravel().tolist()) for t, h in enumerate(truth)], "video_id long, frame_id long, h array<double>")
    frames = f.drop("h").join(own, ["video_id", "frame_id"])
    got = {r.frame_id: r.h for r in chains.replace_segments(frames, p.where("frame_id <> 4"), block=4).collect()}
    assert all(np.allclose(got[t], truth[t].ravel(), atol=1e-6) for t in range(9) if t != 4) and (got[4] is None or np.allclose(got[4], truth[4].ravel(), atol=1e-6))
    none = chains.replace_segments(frames, p.where("frame_id > 99"), block=4).collect()
    assert {r.frame_id for r in none if r.h is None} == {4}
    assert chains.replace_segments(frames.where("frame_id > 99"), p).count() == 0


def test_jumps_cost(spark):
    """A homography that leaves the chain is given up for one that follows it, though its frame's points reward it as much."""
    h = np.array([BASE, BASE @ np.linalg.inv(STEP), BASE])
    step = np.array([STEP] * 3)
    d = chains.jumps(h, step, np.arange(3))
    assert d[0] == 0 and d[1] < 1e-9 < 1e-5 < d[2]
    assert chains.jumps(h, step, np.array([0, 1, 5]))[2] == 0
    assert np.isclose(d[2], court.distance(h[2], h[1] @ np.linalg.inv(STEP)) + court.distance(h[2], h[1] @ np.linalg.inv(STEP), False))


def test_spans_of_any_length(spark):
    """Each pair once; spans of 1 to a million frames, negative ends, spans that end before they begin, nulls and repeated rows."""
    rng = np.random.default_rng(6)
    rows = []
    for side in (0, 1):
        for i in range(120):
            a = int(rng.integers(-500, 2000))
            rows.append((side, int(rng.integers(0, 2)), a, a + int(rng.choice([0, 0, 1, 7, 100, 10_000, 1_000_000]))))
        rows += [(side, 0, 5, 4), (side, 0, None, 4), (side, None, 0, 9), (side, 0, 3, None), (side, 1, 10, 10), (side, 1, 10, 10)]
    df = spark.createDataFrame(rows, "side int, k long, a long, b long")
    l, r = df.where("side = 0").select("k", "a", "b"), df.where("side = 1").select("k", F.col("a").alias("c"), F.col("b").alias("d"))
    got = sorted((x.k, x.a, x.b, x.c, x.d) for x in overlapping(l, r, ["k"], ("a", "b"), ("c", "d")).collect())
    ok = [x for x in rows if None not in x and x[2] <= x[3]]
    want = sorted((x[1], x[2], x[3], y[2], y[3]) for x in ok if x[0] == 0 for y in ok if y[0] == 1 and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want
    assert overlapping(l.where("k > 9"), r, ["k"], ("a", "b"), ("c", "d")).count() == 0
    at = sorted((x.k, x.a, x.c, x.d) for x in points_in_spans(l.select("k", "a"), r, ["k"], "a", "c", "d").collect())
    assert at == sorted((x[1], x[2], y[2], y[3]) for x in rows if x[0] == 0 and x[1] is not None and x[2] is not None for y in ok if y[0] == 1 and x[1] == y[1] and y[2] <= x[2] <= y[3])


def test_span_join_is_an_equi_join(spark):
    df = spark.range(10).selectExpr("id % 2 AS k", "id AS a", "id + 5 AS b")
    plan = overlapping(df, df.selectExpr("k", "a AS c", "b AS d"), ["k"], ("a", "b"), ("c", "d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (") == 2 and "__n" in plan
