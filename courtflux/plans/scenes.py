"""Queries whose inputs are made from the tables so that the truth is known: chains of maps, pooled homographies, spans of any length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains, court, em, smooth, stitch, tables, tracking
from ..operators.relops import overlapping
from ..runtime import scratch, written
from ..sources import lmdb, npz
from ..streaming.events import court_tracked, gated_balls, replayed
from ..streaming.joblog import JobLog
from .derive import Tables, sql
from .extra import _identities, _nearly_all, _smooth
from .queries import FPS, FRAME, ORACLE, query

# -- spans ---------------------------------------------------------------------------------------------------------------------

_SPANS = "SELECT video_id, frame_id * 40 AS a, frame_id * 40 + CASE WHEN frame_id % 25 = det_idx THEN 9999 WHEN frame_id % 3 = 0 THEN 100 ELSE 0 END AS b, det_idx % 2 AS side FROM det WHERE det_idx IN (4, 5)"


@query("e19_overlapping_spans", sql(f"""WITH s AS ({_SPANS})
SELECT x.video_id, x.a, x.b, count(*) AS n, min(y.a) AS first, max(y.b) AS last FROM s x JOIN s y ON x.video_id = y.video_id AND x.side = 0 AND y.side = 1 AND x.a <= y.b AND y.a <= x.b GROUP BY 1, 2, 3""", "det"))
def e19(t: Tables) -> DataFrame:
    """Spans of one side that share a frame with spans of the other; of 1 to 10,000 frames."""
    s = t.spark.sql(_SPANS.replace("FROM det", "FROM {det}"), det=t.det)
    pairs = overlapping(s.where("side = 0").drop("side"), s.where("side = 1").selectExpr("video_id", "a AS c", "b AS d"), ["video_id"], ("a", "b"), ("c", "d"))
    return pairs.groupBy("video_id", "a", "b").agg(F.count("*").alias("n"), F.min("c").alias("first"), F.max("d").alias("last"))


# -- chains of maps ------------------------------------------------------------------------------------------------------------

#: A map from the frame before: a little zoom, turn, move and perspective; missing in some frames.
_FRAMES = "SELECT DISTINCT video_id, frame_id FROM det"
_CELLS = (
    "1 + CAST((frame_id * 7 + video_id) % 5 - 2 AS DOUBLE) / 997", "CAST((frame_id * 3) % 5 - 2 AS DOUBLE) / 2003", "CAST((frame_id * 11 + video_id) % 9 - 3 AS DOUBLE) / 509",
    "CAST((frame_id * 5 + video_id) % 7 - 3 AS DOUBLE) / 1999", "1 + CAST((frame_id * 2) % 5 - 2 AS DOUBLE) / 1009", "CAST((frame_id * 13) % 7 - 3 AS DOUBLE) / 503",
    "CAST(frame_id % 3 - 1 AS DOUBLE) / 1013", "CAST((frame_id * 2 + video_id) % 3 - 1 AS DOUBLE) / 1019", "CAST(1 AS DOUBLE)",
)
_MISSING = {"some": "frame_id % 50 = 33", "one": "frame_id = 150 + 20 * (video_id % 4)"}


def _steps(t: Tables, missing: str) -> DataFrame:
    cells = ", ".join(_CELLS)
    return t.spark.sql(f"SELECT video_id, frame_id, CASE WHEN NOT ({_MISSING[missing]}) THEN array({cells}) END AS step FROM ({_FRAMES.replace('FROM det', 'FROM {det}')})", det=t.det)


def _product_sql(a: str, b: str) -> str:
    return "[" + ", ".join(" + ".join(f"{a}[{3 * i + k + 1}] * {b}[{3 * k + j + 1}]" for k in range(3)) for i in range(3) for j in range(3)) + "]"


def _inverse_sql(m: str) -> str:
    a, b, c, d, e, f, g, h, i = (f"{m}[{k}]" for k in range(1, 10))
    det = f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
    cof = [(e, i, f, h), (c, h, b, i), (b, f, c, e), (f, g, d, i), (a, i, c, g), (c, d, a, f), (d, h, e, g), (b, g, a, h), (a, e, b, d)]
    return "[" + ", ".join(f"({w} * {x} - {y} * {z}) / {det}" for w, x, y, z in cof) + "]"


def _chain_sql(missing: str, carry: bool, left: bool, body: str) -> str:
    """``body`` after ``w`` (video_id, r, frame_id, m): the chains by recursion over each video's rows."""
    step = f"CASE WHEN NOT ({_MISSING[missing]}) THEN [{', '.join(_CELLS)}]" + (" ELSE [1e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 1e0]" if carry else "") + " END"
    text = sql(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS r, {step} AS m FROM ({_FRAMES}) f),
w AS (SELECT video_id, r, frame_id, [1e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 1e0] AS m FROM s WHERE r = 1
 UNION ALL SELECT s.video_id, s.r, s.frame_id, CASE WHEN s.m IS NOT NULL AND w.m IS NOT NULL THEN {_product_sql(*(("s.m", "w.m") if left else ("w.m", "s.m")))} END FROM w JOIN s ON s.video_id = w.video_id AND s.r = w.r + 1)
{body}""", "det", recursive=True)
    return text


def _cells(df: DataFrame) -> DataFrame:
    return df.select(*FRAME, *((F.round(F.get("m", F.lit(i)), 6) + 0.0).alias(f"m{i}") for i in range(9)))


_CELLS_OUT = ", ".join(f"round(m[{i + 1}], 6) + 0e0 AS m{i}" for i in range(9))


@query("g16_chains", _chain_sql("some", True, True, f"SELECT video_id, frame_id, {_CELLS_OUT} FROM w"))
def g16_chains(t: Tables) -> DataFrame:
    """Products of the maps from each video's first frame on; a missing map carries the product before."""
    return _cells(chains.chains(_steps(t, "some"), block=16))


#: The centre (0.5, 0.5) of frame i seen from frame r, of chains multiplied from the right up to the first missing map.
_FAR = f"""v AS (SELECT video_id, frame_id, r, m, {_inverse_sql("m")} AS i FROM w WHERE m IS NOT NULL),
far AS (SELECT a.video_id, a.frame_id, max(sqrt(pow(q[1] / q[3] - 0.5e0, 2) + pow(q[2] / q[3] - 0.5e0, 2))) AS d
 FROM v a JOIN (SELECT video_id, [(i[1] + i[2]) * 0.5e0 + i[3], (i[4] + i[5]) * 0.5e0 + i[6], (i[7] + i[8]) * 0.5e0 + i[9]] AS p FROM v) b ON a.video_id = b.video_id,
 LATERAL (SELECT [a.m[1] * p[1] + a.m[2] * p[2] + a.m[3] * p[3], a.m[4] * p[1] + a.m[5] * p[2] + a.m[6] * p[3], a.m[7] * p[1] + a.m[8] * p[2] + a.m[9] * p[3]] AS q) x GROUP BY 1, 2)"""


@query("g16_reference_frames", _chain_sql("one", False, False, f", {_FAR} SELECT video_id, arg_min(frame_id, d) AS ref, round(min(d), 6) AS farthest FROM far GROUP BY 1"))
def g16_reference(t: Tables) -> DataFrame:
    """The frame of each video from which the farthest of all frames' centres is nearest."""
    got = chains.reference_frames(_steps(t, "one"), 1.0, 1.0, block=16)
    return got.select("video_id", "ref", F.round("farthest", 6).alias("farthest"))


@query("g16_to_reference", _chain_sql("some", True, False, f"""SELECT video_id, frame_id, {_CELLS_OUT} FROM (
 SELECT w.video_id, w.frame_id, {_product_sql("x.i", "w.m")} AS m FROM w JOIN (SELECT video_id, {_inverse_sql("m")} AS i FROM w QUALIFY r = (count(*) OVER (PARTITION BY video_id) + 1) // 2) x USING (video_id)) y"""))
def g16_to_reference(t: Tables) -> DataFrame:
    """The maps from each video's middle frame to its others, both ways from it."""
    steps = _steps(t, "some")
    middle = steps.groupBy("video_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY frame_id)").cast("long").alias("ref"))
    return _cells(chains.to_reference(chains.chains(steps, left=False, block=16), middle, left=False))


# -- pooled homographies -------------------------------------------------------------------------------------------------------

#: The first frame's homography, and how far a frame's picture is moved from the one before.
_H0, _MOVE = (1.1, 0.02, -0.4, 0.01, 0.9, -0.45, 0.05, 0.03, 1.0), (0.002, -0.001)
#: Three points of the court and two wrong ones a frame; in every fifth frame two points alone.
_SEEN = f"""SELECT video_id, frame_id, k, CAST((frame_id * 37 + k * 61 + video_id * 11) % 101 AS DOUBLE) / 101 AS qx, CAST((frame_id * 53 + k * 29 + video_id * 7) % 97 AS DOUBLE) / 97 AS qy, k > 2 AS wrong
FROM (SELECT DISTINCT video_id, frame_id, det_idx AS k FROM det WHERE det_idx < 5 AND (frame_id % 5 <> 0 OR det_idx < 2))"""


def _true_sql() -> list[str]:
    """The cells of frame_id's true homography, by SQL that both engines run: the first frame's after moving back."""
    a, b, c, d, e, f, g, h, i = _H0
    x, y = (f"frame_id * {m:+}" for m in _MOVE)
    w = f"({i} - {g} * ({x}) - {h} * ({y}))"
    cells = [f"{a}", f"{b}", f"({c} - {a} * ({x}) - {b} * ({y}))", f"{d}", f"{e}", f"({f} - {d} * ({x}) - {e} * ({y}))", f"{g}", f"{h}"]
    return [f"CAST({v} AS DOUBLE) / CAST({w} AS DOUBLE)" for v in cells]


@query("i15_pooled_segments", sql(f"SELECT video_id, frame_id, {', '.join(f'round({v}, 4) + 0e0 AS h{i}' for i, v in enumerate(_true_sql()))}, FALSE AS own_is_right FROM ({_FRAMES}) f", "det"))
def i15(t: Tables) -> DataFrame:
    """No frame's own points give its homography (too few, or two of five wrong); pooled over segments they do."""
    seen = t.spark.sql(_SEEN.replace("FROM det", "FROM {det}"), det=t.det)
    a, b, c, d, e, f, g, h, i = _H0
    w = F.expr(f"{g} * qx + {h} * qy + {i}")
    u, v = F.expr(f"{a} * qx + {b} * qy + {c}") / w, F.expr(f"{d} * qx + {e} * qy + {f}") / w
    off = F.when(F.col("wrong"), F.expr("0.3 + CAST((frame_id * 17 + k * 5) % 13 AS DOUBLE) / 20")).otherwise(0.0)
    pts = seen.select(*FRAME, (F.col("qx") + F.col("frame_id") * _MOVE[0]).alias("sx"), (F.col("qy") + F.col("frame_id") * _MOVE[1]).alias("sy"), (u + off).alias("dx"), (v - off).alias("dy"))
    step = F.array(*(F.lit(x) for x in (1.0, 0.0, _MOVE[0], 0.0, 1.0, _MOVE[1], 0.0, 0.0, 1.0)))
    own = written(court.fit_frames(pts))  # read three times
    frames = t.det.select(*FRAME).distinct().join(own, FRAME, "left").withColumn("step", step)
    got = chains.replace_segments(frames, pts, block=64).join(own.withColumnRenamed("h", "own"), FRAME, "left")
    true = F.array(*(F.expr(x.replace("frame_id", "CAST(frame_id AS DOUBLE)")) for x in _true_sql()))
    far = F.array_max(F.transform(F.arrays_zip(F.slice("own", 1, 8).alias("x"), true.alias("y")), lambda p: F.abs(p["x"] - p["y"])))
    return got.select(*FRAME, *((F.round(F.get("h", F.lit(k)), 4) + 0.0).alias(f"h{k}") for k in range(8)), (F.coalesce(far, F.lit(9.0)) < 1e-3).alias("own_is_right"))


# -- jobs as a log -------------------------------------------------------------------------------------------------------------

#: Each user's events as a job's: the first names it, clicks take it into work, others end it one way or another.
_LOG = """SELECT CAST(user_id AS VARCHAR) AS job_id, ts AS tm, event_id AS seq,
 CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'queued' END AS status,
 CASE WHEN event_type = 'purchase' THEN 'value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS error, CASE WHEN event_id % 7 = 0 THEN 'v' || CAST(event_id AS VARCHAR) END AS video_name FROM events"""
_LOG_STATE = """SELECT job_id AS id, arg_max(status, {'t': tm, 's': seq}) FILTER (status IS NOT NULL) AS status, arg_max(error, {'t': tm, 's': seq}) FILTER (error IS NOT NULL) AS error,
 arg_max(video_name, {'t': tm, 's': seq}) FILTER (video_name IS NOT NULL) AS video_name FROM l GROUP BY 1"""


def _logged(t: Tables) -> JobLog:
    """The events in a log, by a stream of five batches of which the last one is written twice, with a compaction between others."""
    events = t.spark.sql(_LOG.replace("FROM events", "FROM {events}").replace("VARCHAR", "STRING"), events=t.read("events")).withColumnRenamed("tm", "at")
    folder, log = scratch(t.spark), JobLog(t.spark, scratch(t.spark))
    events.repartition(5).write.option("maxRecordsPerFile", 1 << 20).parquet(folder)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    log.sink(stream, scratch(t.spark), availableNow=True).awaitTermination()
    w, b = max(log._batches())
    again = t.spark.read.parquet(f"{log.path}/batches/writer={w}/batch={b}")
    log.append(written(again), b, w)
    log.compact()
    return log


@query("m2_logged_jobs", f"WITH l AS ({_LOG}) {_LOG_STATE}")
def m2_logged(t: Tables) -> DataFrame:
    """The state of jobs from a log that a stream has written and a compaction has shortened."""
    return _logged(t).jobs().select("id", "status", "error", "video_name")


@query("m3_recovered_log", f"WITH l AS ({_LOG}), s AS ({_LOG_STATE}) SELECT id, CASE WHEN status = 'processing' THEN CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'queued' ELSE 'failed' END ELSE status END AS status, CASE WHEN status = 'processing' AND CAST(id AS BIGINT) % 3 <> 0 THEN 'the file is gone' ELSE error END AS error FROM s")
def m3_log(t: Tables) -> DataFrame:
    """Jobs in work after a restart, told from the log alone; the recovery's events are written twice."""
    log = _logged(t)
    files = t.read("events").where("user_id % 3 = 0").selectExpr("CAST(user_id AS STRING) AS id")
    log.recover(files, 0)
    log.recover(files, 0)
    log.compact()
    return log.jobs().select("id", "status", "error")


# -- streams by event time -----------------------------------------------------------------------------------------------------


def _timed(rows: DataFrame) -> DataFrame:
    """Rows with the times of their frames, thirty a second, of which some come late within the stream's lateness."""
    return rows.withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.floor(F.col("frame_id") * 1_000_000 / 30)))


def _end(rows: DataFrame) -> DataFrame:
    """One row of no video, an hour behind the last."""
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return last.select(*(F.lit(-1).cast("long").alias(c) if c in ("video_id", "frame_id", "det_idx") else F.col("ts") if c == "ts" else F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in rows.columns))


@query("k_event_time_balls", ORACLE["d13_ball_gate"])
def k_balls(t: Tables) -> DataFrame:
    """The ball gate as a stream by event time, in micro-batches; its rows are those of the batch."""
    c = t.det.where("det_idx in (0, 3)").select(*FRAME, "det_idx", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("confidence").alias("score"))
    rows = _timed(c)
    got = replayed(rows, gated_balls, _end(rows)).where("video_id >= 0")
    side = {"x1": ("x", -10), "y1": ("y", -10), "x2": ("x", 10), "y2": ("y", 10)}
    return got.select(*FRAME, "x", "y", "score", *((F.col(c).cast("long") + d).alias(n) for n, (c, d) in side.items()))


@query("i6_streamed_court", ORACLE["i6_court_known"])
def i6_streamed(t: Tables) -> DataFrame:
    """The court tracker as a stream by event time: players that move smoothly keep their ids."""
    smooth = _smooth(t)
    rows = _timed(smooth)
    got = replayed(rows.drop("truth"), court_tracked, _end(rows.drop("truth"))).where("video_id >= 0")
    return _nearly_all(t, _identities(smooth.join(got, [*FRAME, "det_idx"])))


# -- trackers on players that cross, hide and leave ----------------------------------------------------------------------------

#: 1 and 2 cross, 2 hidden behind 1 for five frames; 4 is hidden for 40 beside 3 and comes back for 30; 5 leaves by the picture's left side and comes back after 40;
#: 6 is gone from the middle of the court for 40 and comes back for 20; 7 and 8, of one team's colours, run through each other. Every row is a player's.
_SCENE = """SELECT video_id, frame_id, det_idx, truth, x1, y1, x1 + 40 AS x2, y1 + 120 AS y2, confidence FROM (
 SELECT video_id, frame_id, det_idx, player_id AS truth, confidence,
  CASE player_id WHEN 1 THEN 300 + 6 * w WHEN 2 THEN 300 + 6 * (50 - w) WHEN 3 THEN 900 + 2 * w WHEN 4 THEN 920 + 2 * w
   WHEN 5 THEN CASE WHEN frame_id < 60 THEN 4 * greatest(0, 38 - frame_id) ELSE 4 * greatest(0, frame_id - 81) END WHEN 6 THEN 700 + w WHEN 7 THEN 1200 + 6 * w ELSE 1200 + 6 * (50 - w) END AS x1,
  CASE WHEN player_id <= 2 THEN 200 WHEN player_id <= 4 THEN 330 WHEN player_id = 5 THEN 460 WHEN player_id = 6 THEN 590 ELSE 720 END AS y1
 FROM (SELECT *, abs(frame_id % 100 - 50) AS w FROM players) p
 WHERE NOT (player_id = 2 AND frame_id % 50 BETWEEN 23 AND 27) AND NOT (player_id = 4 AND (frame_id BETWEEN 40 AND 79 OR frame_id >= 110)) AND NOT (player_id IN (5, 6) AND frame_id BETWEEN 40 AND 79) AND NOT (player_id = 6 AND frame_id >= 100)) s"""
#: Rows whose nearest box of the frame before is another player's: where a tracker that looks at places alone goes wrong.
_MISLED = "SELECT a.video_id, a.truth, a.frame_id, arg_min(b.truth, pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2) + b.truth / 100e0) <> a.truth AS off FROM s a JOIN s b ON a.video_id = b.video_id AND a.frame_id = b.frame_id + 1 GROUP BY 1, 2, 3"


def _scene(t: Tables) -> DataFrame:
    rows = t.spark.sql(_SCENE.replace("FROM players", "FROM {players}"), players=t.players)
    look = F.expr("transform(sequence(1, 8), i -> CASE WHEN i = truth THEN 1D ELSE 0.05D * (frame_id % 3) END)")
    team = F.expr("transform(sequence(1, 4), i -> CASE WHEN i = (truth + 1) DIV 2 THEN 1D ELSE 0.1D END)")
    return rows.withColumn("reid", look).withColumn("color", team).withColumn("court_x", (F.col("x1") + 20) / 1920 * 28 - 14).withColumn("court_y", F.col("y2") / 1080 * 15 - 7.5)


def _scene_sql(ids: str, rows: str = "TRUE", slack: int = 0) -> str:
    """Per player the ids it has, how many players share them, whether all of ``rows`` have one (but ``slack`` an id), and how often places mislead."""
    return sql(f"""WITH s AS ({_SCENE}), m AS ({_MISLED})
SELECT s.video_id, s.truth, {ids} AS ids, CAST(1 AS BIGINT) AS players, {"TRUE AS nearly_all" if slack else "count(*) AS n"}, any_value(k.misled) AS misled
FROM s JOIN (SELECT video_id, CAST(sum(CASE WHEN off THEN 1 ELSE 0 END) AS BIGINT) AS misled FROM m GROUP BY 1) k USING (video_id) WHERE {rows} GROUP BY 1, 2""", "players")


def _told(t: Tables, tracked: DataFrame, slack: int = 0) -> DataFrame:
    s = _scene(t)
    a, b = s.select("video_id", "frame_id", "truth", "x1", "y1"), s.select("video_id", (F.col("frame_id") + 1).alias("frame_id"), F.col("truth").alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    near = a.join(b, FRAME).groupBy("video_id", "frame_id", "truth").agg(F.min_by("t", F.pow(F.col("x1") - F.col("x"), 2) + F.pow(F.col("y1") - F.col("y"), 2) + F.col("t") / 100.0).alias("t"))
    misled = near.groupBy("video_id").agg(F.sum(F.when(F.col("t") != F.col("truth"), 1).otherwise(0)).alias("misled"))
    got = _identities(tracked).join(misled, "video_id")
    if not slack:
        return got
    total = s.groupBy("video_id", "truth").agg(F.count("*").alias("total"))
    return got.join(total, ["video_id", "truth"]).select("video_id", "truth", "ids", "players", (F.col("total") - F.col("n") <= slack * F.col("ids")).alias("nearly_all"), "misled")


@query("i2_flow_scene", _scene_sql("CAST(1 AS BIGINT)", "NOT (truth = 6 AND frame_id > 60)"))
def i2_scene(t: Tables) -> DataFrame:
    """The flow keeps those who cross, links 4 behind 3 and 5 off the picture, and starts no track in the middle of the court (6)."""
    return _told(t, tracking.track_flow(_scene(t), FPS, tracking.FlowConfig(tracks=8)))


_TWICE = "CASE WHEN truth IN (4, 5, 6) AND min(frame_id) < 40 AND max(frame_id) > 64 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END"


@query("i6_court_scene", _scene_sql(_TWICE, slack=3))
def i6_scene(t: Tables) -> DataFrame:
    """The court tracker keeps those who cross or hide for a few frames; those who are away for over ``max_age`` frames come back as others."""
    return _told(t, tracking.track_court(_scene(t)), slack=3)


@query("i9_appearance_scene", _scene_sql(_TWICE))
def i9_scene(t: Tables) -> DataFrame:
    return _told(t, tracking.track_appearance(_scene(t).withColumn("player_id", F.lit(-1).cast("long"))))


@query("i11_split_scene", sql(f"WITH s AS ({_SCENE}) SELECT video_id, truth, count(*) AS n, CAST(1 AS BIGINT) AS ids, CAST(1 AS BIGINT) AS players FROM s GROUP BY 1, 2", "players"))
def i11_scene(t: Tables) -> DataFrame:
    """Tracklets in which 7 and 8 change places at frame 50, and which break off where 4, 5 and 6 are away: split, then merged into eight."""
    mixed = F.expr("CASE WHEN frame_id >= 50 AND truth IN (7, 8) THEN 15 - truth WHEN frame_id > 64 AND truth IN (4, 5, 6) THEN 10 + truth ELSE truth END")
    rows = _scene(t).withColumn("player_id", mixed.cast("long"))
    return _identities(stitch.stitch(rows, FPS, stitch.StitchConfig(players=8)))


# -- files of other systems ----------------------------------------------------------------------------------------------------


def _local(path: str) -> str:
    return path.removeprefix("file://")


@query("a18_lmdb_labels", "SELECT c_custkey AS index, c_name || repeat('x', CAST(c_custkey % 3000 AS INT)) AS label FROM customer")
def a18_lmdb(t: Tables) -> DataFrame:
    """Labels written as LMDB environments and read back by their pages; among keys of other kinds."""
    c = t.read("customer")
    label = F.concat("c_name", F.expr("repeat('x', CAST(c_custkey % 3000 AS INT))"))
    rows = c.select(F.format_string("label-%09d", "c_custkey").cast("binary").alias("key"), label.cast("binary").alias("value"))
    images = c.select(F.format_string("image-%09d", "c_custkey").cast("binary").alias("key"), F.col("c_name").cast("binary").alias("value"))
    folder = _local(scratch(t.spark))
    lmdb.write_lmdb(rows.unionAll(images), folder, 4)
    return lmdb.labels(t.spark, folder)


@query("b5_npz_samples", sql("""SELECT video_id, frame_id, CASE WHEN h.m IS NOT NULL THEN h.m + 1e0 END AS h0, b.x1, b.confidence FROM (SELECT DISTINCT video_id, frame_id FROM det) f
 LEFT JOIN homographies h USING (video_id, frame_id) LEFT JOIN (SELECT video_id, frame_id, CAST(x1 AS DOUBLE) AS x1, confidence FROM balls WHERE confidence > 0.01) b USING (video_id, frame_id)""", "homographies", "balls"))
def b5_npz(t: Tables) -> DataFrame:
    """Samples of videos written as NPZ files and read back, those without a homography or ball masked."""
    h = t.homographies.select(*FRAME, F.array(F.col("m") + 1.0, *(F.lit(float(i)) for i in range(1, 9))).alias("h"))
    b = t.balls.where("confidence > 0.01").select(*FRAME, F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).alias("ball"), F.col("confidence").alias("ball_conf"))
    none = {"rim": F.lit(None).cast("array<double>"), "rim_conf": F.lit(None).cast("double")}
    frames = t.det.select(*FRAME).distinct().join(h, FRAME, "left").join(b, FRAME, "left").withColumns(none).withColumn("path", F.format_string("v%d.npz", "video_id"))
    folder = scratch(t.spark)
    npz.write_samples(frames, folder)
    got = npz.read_samples(t.spark, folder).withColumn("video_id", F.expr("CAST(substring(path, 2, length(path) - 5) AS BIGINT)"))
    return got.select(*FRAME, F.get("h", F.lit(0)).alias("h0"), F.get("ball", F.lit(0)).alias("x1"), F.col("ball_conf").alias("confidence"))


# -- one model of all tracks ---------------------------------------------------------------------------------------------------

#: Horizontal places of the ball, a frame in nine without one; the model is a random walk that is pulled back, seen with noise.
_WALK = "SELECT video_id, frame_id, CAST(0 AS BIGINT) AS player_id, CASE WHEN frame_id % 9 <> 4 THEN (x1 - 400) / 200e0 END AS z FROM balls"
_EM_ROUNDS = 2


def _em_sql() -> str:
    """Filter, smoother and new parameters of each round, for a state of one dimension, as recursive tables."""
    parts = [f"n AS (SELECT video_id, z, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS t FROM ({_WALK}) w)"]
    parts.append("k0 AS (SELECT 1e0 AS a, 1e0 AS q, 1e0 AS r, 0e0 AS mean, 1e0 AS cov)")
    for i in range(_EM_ROUNDS):
        parts.append(f"""f{i} AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS t, mean AS m, cov AS p, 0e0 AS m0, 0e0 AS p0, 0e0 AS ll, CAST(NULL AS DOUBLE) AS z, a, q, r FROM n, k{i}
 UNION ALL SELECT video_id, t, CASE WHEN z IS NULL THEN m0 ELSE m0 + p0 / (p0 + r) * (z - m0) END, CASE WHEN z IS NULL THEN p0 ELSE p0 * r / (p0 + r) END, m0, p0,
  CASE WHEN z IS NULL THEN 0e0 ELSE -0.5e0 * (ln(2 * pi() * (p0 + r)) + pow(z - m0, 2) / (p0 + r)) END, z, a, q, r
 FROM (SELECT n.video_id, n.t, n.z, f.a * f.m AS m0, f.a * f.a * f.p + f.q AS p0, f.a, f.q, f.r FROM f{i} f JOIN n ON n.video_id = f.video_id AND n.t = f.t + 1))""")
        parts.append(f"""s{i} AS (SELECT f.video_id, f.t, f.m AS s, f.p AS v, CAST(NULL AS DOUBLE) AS crossed FROM f{i} f JOIN (SELECT video_id, max(t) AS t FROM n GROUP BY 1) e USING (video_id, t)
 UNION ALL SELECT f.video_id, f.t, f.m + g * (s - y.m0), f.p + g * g * (v - y.p0), v * g + s * (f.m + g * (s - y.m0))
 FROM (SELECT x.video_id, x.t, x.s, x.v, y.m0, y.p0, f.p * f.a / y.p0 AS g FROM s{i} x JOIN f{i} y USING (video_id, t) JOIN f{i} f ON f.video_id = x.video_id AND f.t = x.t - 1) y JOIN f{i} f ON f.video_id = y.video_id AND f.t = y.t - 1)""")
        parts.append(f"""u{i} AS (SELECT sum(crossed) AS x, sum(CASE WHEN crossed IS NOT NULL THEN v + s * s END) AS before, sum(CASE WHEN t > 0 THEN v + s * s END) AS after, count(crossed) AS steps,
  avg(CASE WHEN z IS NOT NULL THEN pow(z - s, 2) + v END) AS r, avg(CASE WHEN t = 0 THEN s END) AS mean, avg(CASE WHEN t = 0 THEN v + s * s END) AS first, sum(ll) AS ll FROM s{i} JOIN f{i} USING (video_id, t))""")
        parts.append(f"k{i + 1} AS (SELECT x / before AS a, (after - x * x / before) / steps AS q, r, mean, first - mean * mean AS cov FROM u{i})")
    rows = [f"SELECT '{c}' AS name, round({c}, 5) + 0e0 AS value FROM k{_EM_ROUNDS}" for c in ("a", "q", "r", "mean", "cov")]
    rows += [f"SELECT 'likelihood{i}', round(ll / (SELECT count(z) FROM n), 5) FROM u{i}" for i in range(_EM_ROUNDS)]
    return sql(f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}", "balls", recursive=True)


@query("g10_fitted_model", _em_sql())
def g10(t: Tables) -> DataFrame:
    """One model of all videos' balls, and the rounds' log-likelihoods for each observation."""
    walk = t.spark.sql(_WALK.replace("FROM balls", "FROM {balls}"), balls=t.balls)
    one = np.eye(1)
    model, path = em.fit(walk, smooth.Kalman(one, one, one, one, np.zeros(1), one), ["z"], _EM_ROUNDS, fixed=("h",))
    seen = walk.where("z IS NOT NULL").agg(F.count("*").alias("n"))
    found = em.parameters(t.spark, model).where("name <> 'h'").select("name", "value")
    likely = t.spark.createDataFrame([(f"likelihood{i}", x) for i, x in enumerate(path)], "name string, value double")
    return found.unionAll(likely.join(F.broadcast(seen)).select("name", F.col("value") / F.col("n"))).select("name", (F.round("value", 5) + 0.0).alias("value"))


# -- trackers in SQL -----------------------------------------------------------------------------------------------------------


def _by_function(t: Tables, tracker: str) -> DataFrame:
    tables.register(t.spark)
    return t.spark.sql(f"SELECT * FROM track(TABLE(SELECT * FROM {{scene}}), '{tracker}')", scene=_scene(t))


@query("l_track_court", ORACLE["i6_court_scene"])
def l_court(t: Tables) -> DataFrame:
    """The court tracker as a table function."""
    return _told(t, _by_function(t, "court"), slack=3)


@query("l_track_appearance", ORACLE["i9_appearance_scene"])
def l_appearance(t: Tables) -> DataFrame:
    """The appearance tracker as a table function."""
    return _told(t, _by_function(t, "appearance"))
