"""Queries of augmentation, distances of homographies, splits and batches, job stamps, and tracks that compete for their truth."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import court, metrics, refine, smooth
from . import timeline as T
from .derive import Tables, sql
from .extra import _round
from .queries import FRAME, HEIGHT, WIDTH, _homographies, query
from .scenes import _H0, _MOVE as _PAN, _SEEN, _inverse_sql, _product_sql, _true_sql

# -- augmentation --------------------------------------------------------------------------------------------------------------

_MOVE = {"angle": 0.1, "scale": 1.1, "dx": 0.02, "dy": -0.03}
_MIRROR = "CASE WHEN p < 13 THEN p + 16 WHEN p = 13 THEN 15 WHEN p = 14 THEN 14 WHEN p = 15 THEN 13 WHEN p < 29 THEN p - 16 WHEN p < 31 THEN p + 2 ELSE p - 2 END"


def _moved_sql(x: str, y: str) -> tuple[str, str]:
    c, s = math.cos(_MOVE["angle"]), math.sin(_MOVE["angle"])
    u, v = f"({x} - 0.5e0)", f"({y} - 0.5e0)"
    return f"({_MOVE['scale']}e0 * ({c!r}e0 * {u} - {s!r}e0 * {v}) + 0.5e0 + {_MOVE['dx']}e0)", f"({_MOVE['scale']}e0 * ({s!r}e0 * {u} + {c!r}e0 * {v}) + 0.5e0 + ({_MOVE['dy']}e0))"


_UNIT = {"x1": "(x1 / 1920e0)", "y1": "(y1 / 1080e0)", "x2": "(x2 / 1920e0)", "y2": "(y2 / 1080e0)"}
_CORNERS = [_moved_sql(_UNIT[a], _UNIT[b]) for a in ("x1", "x2") for b in ("y1", "y2")]


def _unit_boxes(t: Tables) -> DataFrame:
    return t.det.withColumns({c: F.col(c) / (WIDTH if c[0] == "x" else HEIGHT) for c in ("x1", "y1", "x2", "y2")})


@query("c15_augmented_points", sql(f"SELECT video_id, frame_id, det_idx, {_MIRROR} AS point, round(1 - {_moved_sql(_UNIT['x1'], _UNIT['y1'])[0]}, 6) AS px, round({_moved_sql(_UNIT['x1'], _UNIT['y1'])[1]}, 6) AS py FROM (SELECT *, (frame_id + det_idx) % 33 AS p FROM det) d", "det"))
def c15_points(t: Tables) -> DataFrame:
    """Key points turned, scaled, moved and mirrored, under the mirrored court's ids."""
    rows = _unit_boxes(t).select(*FRAME, "det_idx", ((F.col("frame_id") + F.col("det_idx")) % 33).cast("int").alias("point"), F.col("x1").alias("px"), F.col("y1").alias("py"))
    got = court.augment_points(rows, flip=True, **_MOVE)
    return _round(got.select(*FRAME, "det_idx", F.col("point").cast("long").alias("point"), "px", "py"), "px", "py")


@query("c15_augmented_boxes", sql(f"SELECT video_id, frame_id, det_idx, round(1 - greatest({', '.join(x for x, _ in _CORNERS)}), 6) AS x1, round(least({', '.join(y for _, y in _CORNERS)}), 6) AS y1, round(1 - least({', '.join(x for x, _ in _CORNERS)}), 6) AS x2, round(greatest({', '.join(y for _, y in _CORNERS)}), 6) AS y2 FROM det", "det"))
def c15_boxes(t: Tables) -> DataFrame:
    got = court.augment_boxes(_unit_boxes(t), flip=True, **_MOVE)
    return _round(got.select(*FRAME, "det_idx", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")


# -- homographies --------------------------------------------------------------------------------------------------------------


def _turned_sql(d: str, probes: tuple[float, float, float]) -> str:
    out = []
    for x in probes:
        for y in probes:
            w = [f"({d}[{3 * i + 1}] * {x}e0 + {d}[{3 * i + 2}] * {y}e0 + {d}[{3 * i + 3}])" for i in range(3)]
            out.append(f"1 - ({w[0]} * {x}e0 + {w[1]} * {y}e0 + {w[2]}) / (sqrt({w[0]} * {w[0]} + {w[1]} * {w[1]} + {w[2]} * {w[2]}) * sqrt({x * x + y * y + 1}e0))")
    return " + ".join(out)


_H = "[1e0, 0e0, k * 0.001e0 - 0.5e0, 0e0, 1e0, -0.5e0, 0e0, m * 0.05e0, 1e0]"


@query("c17_homography_distances", sql(f"""WITH h AS (SELECT video_id, frame_id, {_H} AS h FROM homographies), p AS (SELECT a.video_id, a.frame_id, a.h AS a, b.h AS b FROM h a JOIN h b ON a.video_id = b.video_id AND b.frame_id = a.frame_id + 1),
i AS (SELECT *, {_inverse_sql('a')} AS ia, {_inverse_sql('b')} AS ib FROM p), d AS (SELECT *, {_product_sql('ia', 'b')} AS d1, {_product_sql('ib', 'a')} AS d2, {_product_sql('b', 'ia')} AS d3, {_product_sql('a', 'ib')} AS d4 FROM i)
SELECT video_id, frame_id, round(({_turned_sql('d1', (0, 0.5, 1))} + {_turned_sql('d2', (0, 0.5, 1))}) * 1000 + 1e-9, 5) AS picture, round(({_turned_sql('d3', (-0.5, 0, 0.5))} + {_turned_sql('d4', (-0.5, 0, 0.5))}) * 1000 + 1e-9, 5) AS court FROM d""", "homographies"))
def c17(t: Tables) -> DataFrame:
    """How far each frame's homography is from the next one's, seen in the picture and on the court."""
    h = _homographies(t)
    after = h.select("video_id", (F.col("frame_id") - 1).alias("frame_id"), F.col("h").alias("b"))
    d = {n: F.round(G.homography_distance(F.col("h"), F.col("b"), n == "picture") * 1000 + 1e-9, 5).alias(n) for n in ("picture", "court")}
    return h.join(after, FRAME).select(*FRAME, *d.values())


@query("i17_baseline_homographies", sql(f"SELECT video_id, frame_id, {', '.join(f'round({_H}[{i + 1}], 4) + 0e0 AS h{i}' for i in range(9))} FROM homographies", "homographies"))
def i17(t: Tables) -> DataFrame:
    """A frame's twelve points, a quarter of them far off: four that agree with most, then all that agree."""
    rows = t.det.select(*FRAME, "det_idx", (F.col("x1") / WIDTH).alias("sx"), (F.col("y1") / HEIGHT).alias("sy")).join(_homographies(t), FRAME)
    x, y = G.project(F.col("h"), F.col("sx"), F.col("sy"))
    off = F.when(F.col("det_idx") % 4 == 1, 0.2 + (F.col("frame_id") * 7 + F.col("det_idx")) % 11 / 20.0).otherwise(0.0)
    got = court.least_squares(rows.select(*FRAME, "sx", "sy", (x + off).alias("dx"), (y - off).alias("dy")))
    return got.select(*FRAME, *((F.round(F.get("h", F.lit(i)), 4) + 0.0).alias(f"h{i}") for i in range(9)))


_TRUE = _true_sql()
_OFF = [f"CAST((frame_id * {7 + 2 * i} + video_id * 3 + {i}) % 11 - 5 AS DOUBLE) / 1000" for i in range(8)]


@query("i16_refined_homographies", sql("SELECT video_id, frame_id, frame_id % 7 <> 3 AND greatest(" + ", ".join(f"abs({o})" for o in _OFF) + ") < 1e-3 AS start_is_right, TRUE AS is_right, round(CASE WHEN frame_id % 5 = 0 THEN 2e0 ELSE 3e0 END, 2) AS reward FROM (SELECT DISTINCT video_id, frame_id FROM det) f", "det"))
def i16(t: Tables) -> DataFrame:
    """Homographies that are off or missing, three points a frame or two: too few for any frame alone, enough for the chain."""
    seen = t.spark.sql(_SEEN.replace("FROM det", "FROM {det}"), det=t.det).where("NOT wrong")
    a, b, c, d, e, f, g, h, i = _H0
    w = F.expr(f"{g} * qx + {h} * qy + {i}")
    at = [F.expr(f"{x} * qx + {y} * qy + {z}") / w for x, y, z in ((a, b, c), (d, e, f))]
    pts = seen.select(*FRAME, (F.col("qx") + F.col("frame_id") * _PAN[0]).alias("sx"), (F.col("qy") + F.col("frame_id") * _PAN[1]).alias("sy"), at[0].alias("dx"), at[1].alias("dy"))
    step = F.array(*(F.lit(x) for x in (1.0, 0.0, _PAN[0], 0.0, 1.0, _PAN[1], 0.0, 0.0, 1.0)))
    true = F.array(*(F.expr(x.replace("frame_id", "CAST(frame_id AS DOUBLE)")) for x in _TRUE))
    first = F.array(*(F.expr(f"{x.replace('frame_id', 'CAST(frame_id AS DOUBLE)')} + {o}") for x, o in zip(_TRUE, _OFF)), F.lit(1.0))
    frames = t.det.select(*FRAME).distinct().withColumn("step", step).withColumn("h", F.when(F.col("frame_id") % 7 != 3, first))
    far = lambda m: F.array_max(F.transform(F.arrays_zip(F.slice(m, 1, 8).alias("x"), true.alias("y")), lambda p: F.abs(p["x"] - p["y"])))
    got = refine.refine(frames, pts, block=64).join(frames.select(*FRAME, F.col("h").alias("start")), FRAME)
    return got.select(*FRAME, (F.coalesce(far("start"), F.lit(9.0)) < 1e-3).alias("start_is_right"), (far("h") < 1e-3).alias("is_right"), F.round("reward", 2).alias("reward"))


# -- splits and batches --------------------------------------------------------------------------------------------------------


@query("m6_validation_split", "SELECT count(*) AS total, greatest(1, CAST(floor(count(*) * 0.2e0) AS BIGINT)) AS validation, count(DISTINCT o_orderkey) AS apart FROM orders")
def m6(t: Tables) -> DataFrame:
    """Exactly a fifth of the rows, every row once."""
    got = T.validation_split(t.read("orders").select("o_orderkey"), ["o_orderkey"])
    return got.agg(F.count("*").alias("total"), F.count_if("validation").alias("validation"), F.count_distinct("o_orderkey").alias("apart"))


@query("m7_identity_batch", """WITH n AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 4) SELECT least(16, count(*)) AS identities, least(16, count(*)) * 4 AS images, CASE WHEN count(*) > 0 THEN CAST(4 AS BIGINT) END AS least_each, CASE WHEN count(*) > 0 THEN CAST(4 AS BIGINT) END AS most_each FROM n""")
def m7(t: Tables) -> DataFrame:
    """Sixteen customers with four different orders each, drawn by hashes."""
    got = smooth.identity_batch(t.read("orders").selectExpr("o_custkey AS pid", "o_orderkey AS path"), 16, 4, seed=7)
    each = got.groupBy("pid").agg(F.count_distinct("path").alias("n"))
    return each.agg(F.count("*").alias("identities"), F.coalesce(F.sum("n"), F.lit(0)).alias("images"), F.min("n").alias("least_each"), F.max("n").alias("most_each"))


@query("j6_job_stamps", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'queued' AS status, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-02T03:04:05Z' END AS created_at, c_custkey % 3 <> 0 AS just_now FROM customer")
def j6(t: Tables) -> DataFrame:
    """Jobs that bring their time of creation, and jobs that get one in UTC."""
    c = t.read("customer").selectExpr("CAST(c_custkey AS STRING) AS id", "c_name AS video_name", "c_name AS display_name", "c_custkey % 3 = 0 AS old")
    none = t.spark.createDataFrame([], "id string, video_name string, display_name string, status string, error string, created_at string")
    old = T.inserted(none, c.where("old").drop("old").withColumn("created_at", F.lit("2024-01-02T03:04:05Z")))
    new = T.inserted(none, c.where("NOT old").drop("old"))
    age = F.abs(F.unix_timestamp() - F.unix_timestamp(F.to_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ssX")))
    near = (age < 86400) & F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")
    return old.unionByName(new).select("id", "status", F.when(~near, F.col("created_at")).alias("created_at"), near.alias("just_now"))


# -- tracks that compete -------------------------------------------------------------------------------------------------------

#: Of nineteen limits of the boxes' overlap (0.05 to 0.95) sixteen lie below a prediction's 54 / 66.
_MET = "16 / 19e0"


@query("f15_competing_tracks", sql(f"""WITH g AS (SELECT *, frame_id % 100 < 50 AS early FROM players), p AS (SELECT *, lag(early) OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS was FROM g WHERE frame_id % 17 <> 0),
n AS (SELECT video_id, count(*) AS gt, CAST(sum(CASE WHEN frame_id % 17 <> 0 AND frame_id % 10 = 3 THEN 1 ELSE 0 END) + sum(CASE WHEN frame_id % 13 = 0 AND player_id = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp FROM g GROUP BY 1),
k AS (SELECT video_id, player_id, early, count(*) AS c FROM p GROUP BY 1, 2, 3), gk AS (SELECT video_id, player_id, count(*) AS g FROM g GROUP BY 1, 2),
s AS (SELECT video_id, count(*) AS tp, CAST(sum(CASE WHEN was <> early THEN 1 ELSE 0 END) AS BIGINT) AS idsw FROM p GROUP BY 1), i AS (SELECT video_id, sum(m) AS idtp FROM (SELECT video_id, player_id, max(c) AS m FROM k GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT k.video_id, sum(CAST(c AS DOUBLE) * c / gk.g) AS ass FROM k JOIN gk USING (video_id, player_id) GROUP BY 1)
SELECT video_id, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(gt - tp AS DOUBLE) AS fn, CAST(idsw AS DOUBLE) AS idsw, round(1 - (gt - tp + fp + idsw) / CAST(gt AS DOUBLE), 6) AS mota, round(54 / 66e0, 6) AS motp, CAST(idtp AS DOUBLE) AS idtp, round(2e0 * idtp / (gt + tp + fp), 6) AS idf1,
 round({_MET} * sqrt(tp / CAST(gt + fp AS DOUBLE) * (ass / tp)), 6) AS hota, round({_MET} * tp / CAST(gt + fp AS DOUBLE), 6) AS deta, round({_MET} * ass / tp, 6) AS assa FROM n JOIN s USING (video_id) JOIN i USING (video_id) JOIN a USING (video_id)""", "players"))
def f15_competing(t: Tables) -> DataFrame:
    """Predictions beside their truth, second ones further off under other ids, some where nobody is, ids that change and frames that lack."""
    gt = t.players.withColumnRenamed("player_id", "id")
    beside = lambda d, id_: gt.withColumn("id", F.expr(id_)).withColumns({c: F.col(c) + d for c in ("x1", "x2")})
    main = beside(6, "CASE WHEN frame_id % 100 < 50 THEN id ELSE id + 10 END").where("frame_id % 17 <> 0")
    second = beside(12, "id + 100").where("frame_id % 17 <> 0 AND frame_id % 10 = 3")
    nobody = beside(5000, "CAST(999 AS BIGINT)").where("frame_id % 13 = 0 AND det_idx = 4")
    s = metrics.track_scores(gt, main.unionByName(second).unionByName(nobody))
    return _round(s.select("video_id", "tp", "fp", "fn", "idsw", "mota", "motp", "idtp", "idf1", "hota", "deta", "assa"), "mota", "motp", "idf1", "hota", "deta", "assa")
