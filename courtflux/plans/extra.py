"""Further queries: scalar functions, evaluation of detectors and tracks, documents, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vectors as V
from ..operators import ball, court, detect, enrich, metrics, shots, smooth, stitch, teams, tracking
from ..runtime import scratch
from ..sources import readers, sinks
from . import timeline as T
from .derive import Tables, sql
from .queries import _COS, _COURT, _POSES, FPS, FRAME, HEIGHT, SHOTS, WIDTH, _court, _homographies, _iou, _poses, query


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


# -- scalar functions ----------------------------------------------------------------------------------------------------------


@query("c6_gallery_distance", sql(f"SELECT b.vec_id, round(min({_COS}), 6) AS d FROM vectors a JOIN vectors b ON a.frame_id = b.frame_id AND a.vec_id <> b.vec_id GROUP BY 1", "vectors"))
def c6(t: Tables) -> DataFrame:
    """Each vector's least distance to the gallery of its frame's others."""
    v = t.vectors.select("frame_id", "vec_id", "embedding")
    each = v.groupBy("frame_id").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("g"))
    own = v.join(each, "frame_id").select("vec_id", "embedding", F.transform(F.filter("g", lambda x: x["vec_id"] != F.col("vec_id")), lambda x: x["embedding"]).alias("others"))
    return _round(own.where(F.size("others") > 0).select("vec_id", V.gallery_distance(F.col("others"), F.col("embedding")).alias("d")), "d")


@query("c9_clipped", sql("""WITH m AS (SELECT video_id, frame_id, det_idx, greatest(x1 - 150, 0) AS x1, greatest(y1 - 330, 0) AS y1, least(x2 - 150, 1200) AS x2, least(y2 - 330, 200) AS y2 FROM det)
SELECT video_id, frame_id, det_idx, CASE WHEN x2 - x1 >= 5 AND y2 - y1 >= 5 THEN x1 END AS x1, CASE WHEN x2 - x1 >= 5 AND y2 - y1 >= 5 THEN y1 END AS y1, CASE WHEN x2 - x1 >= 5 AND y2 - y1 >= 5 THEN x2 END AS x2, CASE WHEN x2 - x1 >= 5 AND y2 - y1 >= 5 THEN y2 END AS y2 FROM m""", "det"))
def c9(t: Tables) -> DataFrame:
    moved = t.det.selectExpr(*FRAME, "det_idx", "x1 - 150 AS x1", "y1 - 330 AS y1", "x2 - 150 AS x2", "y2 - 330 AS y2")
    return moved.select(*FRAME, "det_idx", G.clip(G.box(), 1200, 200).alias("c")).select(*FRAME, "det_idx", "c.*")


@query("c16_lines", sql("""WITH l AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS n FROM det WHERE x2 > x1)
SELECT video_id, frame_id, det_idx, round(abs((y1 - y2) / n * (500 - x1) + (x2 - x1) / n * (400 - y1)), 6) AS distance,
 round(500 - (y1 - y2) / n * ((y1 - y2) / n * (500 - x1) + (x2 - x1) / n * (400 - y1)) + 1e-9, 5) AS foot_x, round(x1 + (x2 - x1) * (300e0 - y1) / (y2 - y1) + 1e-9, 5) AS meet_x FROM l""", "det"))
def c16(t: Tables) -> DataFrame:
    """The line of a box's diagonal: how far a point is, its foot, and where it meets y = 300."""
    c = [F.col(x) for x in ("x1", "y1", "x2", "y2")]
    own = G.line(*c)
    level = G.line(F.lit(0), F.lit(300), F.lit(10), F.lit(300))
    at = F.lit(500), F.lit(400)
    return t.det.where("x2 > x1").select(*FRAME, "det_idx", F.round(G.line_distance(own, *at), 6).alias("distance"), F.round(G.line_foot(own, *at)[0] + 1e-9, 5).alias("foot_x"), F.round(G.line_meet(own, level)[0] + 1e-9, 5).alias("meet_x"))


@query("c16_segments", sql("""SELECT video_id, frame_id, det_idx, greatest(x1, 400) AS a, least(x2, 900) AS b, round(y1 + (y2 - y1) * ((greatest(x1, 400) - x1) / CAST(x2 - x1 AS DOUBLE)), 5) AS ya
 FROM det WHERE x2 > x1 AND x2 > 400 AND x1 < 900""", "det"))
def c16_segments(t: Tables) -> DataFrame:
    """The part of a box's diagonal between x = 400 and x = 900."""
    cut = t.det.select(*FRAME, "det_idx", G.crop_segment(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(400), F.lit(900)).alias("s")).where("s is not null")
    return cut.select(*FRAME, "det_idx", F.bround("s.x1").cast("long").alias("a"), F.bround("s.x2").cast("long").alias("b"), F.round("s.y1", 5).alias("ya"))


@query("c18_units", sql("SELECT video_id, frame_id, det_idx, round(x1 / 28.65e0 + 0.5e0, 6) AS u, round((1 - (y1 / 15.24e0 + 0.5e0)) * 360, 4) AS py FROM det", "det"))
def c18(t: Tables) -> DataFrame:
    u, v = G.metres_to_unit(F.col("x1"), F.col("y1"), 28.65, 15.24)
    return t.det.select(*FRAME, "det_idx", F.round(u, 6).alias("u"), F.round(G.unit_to_pixel(u, v, 640, 360)[1], 4).alias("py"))


@query("c19_event_times", sql("SELECT video_id, frame_id, CASE WHEN video_id % 4 = 0 THEN 0e0 ELSE round_even(frame_id / (video_id % 4 * 8e0), 2) END AS seconds, lpad(CAST(CAST(floor(frame_id * 7 / 60e0) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(frame_id * 7 % 60 AS VARCHAR), 2, '0') AS clock FROM balls", "balls"))
def c19(t: Tables) -> DataFrame:
    """Times of frames (0 without a frame rate), and minutes with seconds (C20)."""
    return t.balls.select(*FRAME, G.event_time(F.col("frame_id"), (F.col("video_id") % 4 * 8).cast("double")).alias("seconds"), G.clock(F.col("frame_id") * 7.0).alias("clock"))


@query("c21_unit_means", sql("""WITH n AS (SELECT frame_id, i, avg(CAST(embedding[i] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))) AS m FROM vectors, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)
SELECT frame_id, i - 1 AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY frame_id)), 6) AS x FROM n""", "vectors"))
def c21(t: Tables) -> DataFrame:
    """The unit vector of each frame's mean of unit vectors."""
    m = V.mean_of_units(t.vectors, ["frame_id"], "embedding")
    return _round(m.select("frame_id", F.posexplode("mean").alias("i", "x")), "x")


@query("c22_wrists", sql("SELECT video_id, frame_id, det_idx, x1 + j AS x FROM players, LATERAL (SELECT unnest([9, 10]) AS j) WHERE (x1 + j) % 10 >= 1", "players"))
def c22(t: Tables) -> DataFrame:
    points = F.expr("transform(sequence(0, 16), j -> named_struct('x', CAST(x1 + j AS DOUBLE), 'y', CAST(y1 AS DOUBLE), 'c', (x1 + j) % 10 / 10D))")
    return t.players.select(*FRAME, "det_idx", F.explode(G.hands(points)).alias("h")).select(*FRAME, "det_idx", F.col("h.x").cast("long").alias("x"))


@query("j2_names", "SELECT c_custkey, 'Customer_' || CAST(c_custkey % 50 AS VARCHAR) || '__.mp4' AS name, 'Customer#' || CAST(c_custkey % 50 AS VARCHAR) || '()' AS stem FROM customer")
def j2(t: Tables) -> DataFrame:
    name = F.expr("concat('/in/Customer#', c_custkey % 50, '().mp4')")
    return t.read("customer").select("c_custkey", X.file_name(name).alias("name"), X.stem(name).alias("stem"))


@query("j4_decoded", """SELECT c_custkey, substr('abcdefghij', 1, 0) || (SELECT string_agg(substr('abcdefghij', CAST(floor(c_custkey / pow(10, j)) AS BIGINT) % 10, 1), '' ORDER BY j) FROM (SELECT unnest(range(0, 5)) AS j) WHERE j < coalesce((SELECT min(k) FROM (SELECT unnest(range(0, 5)) AS k) WHERE CAST(floor(c_custkey / pow(10, k)) AS BIGINT) % 10 = 0), 5)) AS text FROM customer""")
def j4(t: Tables) -> DataFrame:
    """The digits of a key, last first, as tokens: characters up to the first 0."""
    ids = F.expr("transform(sequence(0, 4), j -> CAST(floor(c_custkey / pow(10, j)) AS BIGINT) % 10)")
    got = t.read("customer").select("c_custkey", X.greedy_tokens(ids, F.lit("abcdefghij")).alias("text"))
    return got.withColumn("text", F.when(F.col("text") != "", F.col("text")))


@query("j5_log_lines", sql("SELECT video_id, frame_id, '[INFO] [det' || det_idx || '] box ' || x1 AS line FROM det", "det"))
def j5(t: Tables) -> DataFrame:
    return t.det.select(*FRAME, X.log_line(F.lit("INFO"), F.concat(F.lit("det"), F.col("det_idx").cast("string")), F.concat(F.lit("box "), F.col("x1").cast("string"))).alias("line"))


@query("j9_hues", sql("SELECT DISTINCT player_id, player_id * 137 % 360 AS hue FROM players", "players"))
def j9(t: Tables) -> DataFrame:
    return t.players.select("player_id", G.hue(F.col("player_id")).alias("hue")).distinct()


@query("o4_affine_points", sql("SELECT video_id, frame_id, det_idx, round(2e0 * x1 - y1 + 5, 6) AS u, round(0.5e0 * x1 + 3e0 * y1 - 7, 6) AS v FROM det", "det"))
def o4(t: Tables) -> DataFrame:
    """The map that three point pairs give."""
    src = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    m = G.affine_from_points(src, [(2 * x - y + 5, 0.5 * x + 3 * y - 7) for x, y in src])
    u, v = G.apply_affine(m, F.col("x1"), F.col("y1"))
    return t.det.select(*FRAME, "det_idx", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


# -- filters and joins ---------------------------------------------------------------------------------------------------------


@query("d5_other_taxonomy", sql("SELECT video_id, frame_id, det_idx FROM det WHERE class_id = 1 AND confidence >= 0.2", "det"))
def d5(t: Tables) -> DataFrame:
    return detect.of_class(t.det, "player", 0.2, detect.CLASSES_ALT).select(*FRAME, "det_idx")


@query("d7_best_rims", sql("SELECT video_id, frame_id, arg_max(det_idx, confidence * 1000000 - det_idx) AS det_idx FROM det WHERE class_id = 10 AND confidence >= 0.1 GROUP BY 1, 2", "det"))
def d7(t: Tables) -> DataFrame:
    return detect.best_rim(t.det).select(*FRAME, "det_idx")


@query("d10_untracked", sql("SELECT video_id, frame_id, det_idx, CASE WHEN det_idx % 4 = 0 THEN FALSE ELSE is_dribble END AS is_possession FROM players", "players"))
def d10(t: Tables) -> DataFrame:
    """Exported possession of rows some of which have lost their track (id -1)."""
    rows = t.players.withColumn("player_id", F.expr("CASE WHEN det_idx % 4 = 0 THEN -1 ELSE player_id END")).withColumn("is_possession", F.col("is_dribble")).withColumn("court_x", F.lit(None).cast("double")).withColumn("court_y", F.lit(None).cast("double"))
    return rows.select(*FRAME, "det_idx", sinks.player_struct(rows.columns)["is_possession"].alias("is_possession"))


@query("d16_best_ocr", sql("""WITH c AS (SELECT video_id, frame_id, det_idx % 3 AS box, det_idx AS variant, CASE WHEN det_idx % 5 = 0 THEN NULL ELSE x1 % 100 END AS num, confidence AS conf FROM det)
SELECT video_id, frame_id, box AS det_idx, num, conf AS confidence FROM c WHERE num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, box ORDER BY conf DESC, variant) = 1 AND conf >= 0.7""", "det"))
def d16(t: Tables) -> DataFrame:
    from ..config import Config

    rows = t.det.selectExpr(*FRAME, "det_idx % 3 AS det_idx", "det_idx AS variant", "CASE WHEN det_idx % 5 = 0 THEN NULL ELSE x1 % 100 END AS num", "confidence AS conf")
    return detect.best_ocr(rows, Config(ocr_conf=0.7))


@query("d15_unanimous_votes", sql("""WITH v AS (SELECT video_id, frame_id, det_idx % 4 AS box, x1 % 2 AS num, confidence FROM det)
SELECT video_id, frame_id, box AS det_idx, max(num) AS num, round(avg(confidence), 6) AS confidence FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT num) = 1 AND min(confidence) >= 0.3""", "det"))
def d15_unanimous(t: Tables) -> DataFrame:
    from ..config import Config

    votes = t.det.selectExpr(*FRAME, "det_idx % 4 AS det_idx", "det_idx AS variant", "x1 % 2 AS num", "confidence AS conf")
    return _round(detect.vote_numbers(votes, Config(ocr_conf=0.3), "unanimous"), "confidence")


@query("d17_all_faults", sql("""WITH a AS (SELECT video_id, frame_id, det_idx, frame_id AS s, frame_id + det_idx - 4 AS e, CASE WHEN det_idx % 3 = 0 THEN NULL ELSE frame_id + 1 END AS ms, CASE WHEN det_idx % 4 = 0 THEN NULL ELSE frame_id + det_idx - 5 END AS me FROM det)
SELECT video_id, frame_id, det_idx, concat_ws(',', CASE WHEN s >= e THEN 'shot_order' END, CASE WHEN ms >= me THEN 'make_order' END, CASE WHEN s < 10 OR e > 200 THEN 'shot_outside_clip' END,
 CASE WHEN ms IS NOT NULL AND (ms < s OR coalesce(me > e, FALSE)) THEN 'make_outside_shot' END, CASE WHEN (ms IS NULL) <> (me IS NULL) THEN 'half_open' END) AS faults FROM a""", "det"))
def d17_all(t: Tables) -> DataFrame:
    a = t.det.selectExpr(*FRAME, "det_idx", "CAST(10 AS BIGINT) AS start_frame", "CAST(200 AS BIGINT) AS finish_frame", "frame_id AS shot_start_frame", "frame_id + det_idx - 4 AS shot_end_frame", "CASE WHEN det_idx % 3 = 0 THEN NULL ELSE frame_id + 1 END AS make_start_frame", "CASE WHEN det_idx % 4 = 0 THEN NULL ELSE frame_id + det_idx - 5 END AS make_end_frame")
    return shots.annotation_faults(a).select(*FRAME, "det_idx", F.array_join("faults", ",").alias("faults"))


@query("d18_clip_ranges", sql("""WITH c AS (SELECT video_id, frame_id, det_idx, 120 AS n, CASE WHEN det_idx % 5 = 0 THEN NULL ELSE frame_id - 20 END AS s, CASE WHEN det_idx % 7 = 0 THEN NULL ELSE frame_id + det_idx * 9 - 60 END AS e FROM det),
k AS (SELECT *, greatest(0, least(coalesce(s, 0), n - 1)) AS a, greatest(0, least(coalesce(e, n - 1), n - 1)) AS b FROM c)
SELECT video_id, frame_id, det_idx, CASE WHEN a < b THEN a ELSE 0 END AS first, CASE WHEN a < b THEN b ELSE n - 1 END AS last FROM k""", "det"))
def d18(t: Tables) -> DataFrame:
    s, e = F.expr("CASE WHEN det_idx % 5 = 0 THEN NULL ELSE frame_id - 20 END"), F.expr("CASE WHEN det_idx % 7 = 0 THEN NULL ELSE frame_id + det_idx * 9 - 60 END")
    a, b = shots.clip_range(s, e, F.lit(120).cast("long"))
    return t.det.select(*FRAME, "det_idx", a.alias("first"), b.alias("last"))


@query("d19_valid_uploads", "SELECT c_custkey FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 6 <> 1 AND c_custkey % 5 <> 2 AND c_custkey % 7 <> 3")
def d19(t: Tables) -> DataFrame:
    rows = t.read("customer").selectExpr("c_custkey", "c_name AS name", "CASE c_custkey % 4 WHEN 0 THEN 'flow' WHEN 1 THEN 'hungarian' WHEN 2 THEN 'appearance' ELSE 'other' END AS tracker", "CASE WHEN c_custkey % 6 = 1 THEN 2147483649 ELSE 2147483648 END AS size", "CASE WHEN c_custkey % 5 = 2 THEN '  ' WHEN c_custkey % 7 = 3 THEN repeat('x', 2001) WHEN c_custkey % 2 = 0 THEN c_comment_or END AS comment".replace("c_comment_or", "repeat('y', 2000)"))
    return T.valid_upload(rows).select("c_custkey")


_MASKS = "masks AS (SELECT video_id, frame_id, det_idx, x1 + 9 * (det_idx % 5) AS x1, y1 + 2 AS y1, CASE WHEN det_idx % 6 = 0 THEN x1 ELSE x2 + 9 * (det_idx % 5) END AS x2, y2 FROM players)"


@query("e23_box_masks", sql(f"""WITH {_MASKS}, p AS (SELECT a.video_id, a.frame_id, a.det_idx AS l, b.det_idx AS r, {_iou('a', 'b')} AS iou FROM players a JOIN masks b USING (video_id, frame_id) WHERE b.x2 > b.x1)
SELECT video_id, frame_id, l AS l_det_idx, r AS r_det_idx, round(iou, 6) AS iou FROM p WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, l ORDER BY iou DESC, r) = 1""", "players"))
def e23(t: Tables) -> DataFrame:
    masks = t.players.selectExpr(*FRAME, "det_idx", "x1 + 9 * (det_idx % 5) AS x1", "y1 + 2 AS y1", "CASE WHEN det_idx % 6 = 0 THEN x1 ELSE x2 + 9 * (det_idx % 5) END AS x2", "y2")
    return _round(enrich.match_masks(t.players, masks), "iou")


@query("e21_all_frames", sql("SELECT DISTINCT video_id, frame_id, det_idx IS NOT NULL AS has_gt, p IS NOT NULL AS has_pred FROM (SELECT video_id, frame_id, 1 AS det_idx FROM balls WHERE frame_id % 3 = 0 GROUP BY 1, 2) g FULL JOIN (SELECT video_id, frame_id, 1 AS p FROM balls WHERE frame_id % 5 = 0 GROUP BY 1, 2) q USING (video_id, frame_id)", "balls"))
def e21(t: Tables) -> DataFrame:
    """The union of two tables' frames (H5)."""
    return T.all_frames(t.balls.where("frame_id % 3 = 0"), t.balls.where("frame_id % 5 = 0")).withColumnsRenamed({"in_a": "has_gt", "in_b": "has_pred"})


@query("f3_jersey_numbers", sql("""WITH n AS (SELECT video_id, player_id, (frame_id * 7 + player_id) % 4 AS num, count(*) AS n, min(frame_id) AS f FROM players WHERE frame_id % 23 = 0 AND player_id < 6 GROUP BY 1, 2, 3),
r AS (SELECT video_id, player_id, num FROM n QUALIFY row_number() OVER (PARTITION BY video_id, player_id ORDER BY n DESC, f) = 1 AND n >= 2)
SELECT p.video_id, p.player_id, r.num AS number FROM (SELECT DISTINCT video_id, player_id FROM players) p LEFT JOIN r USING (video_id, player_id)""", "players"))
def f3(t: Tables) -> DataFrame:
    none = F.lit(None).cast("double")
    rows = t.players.withColumn("num", F.expr("CASE WHEN frame_id % 23 = 0 AND player_id < 6 THEN (frame_id * 7 + player_id) % 4 END")).withColumn("court_x", none).withColumn("court_y", none)
    return stitch.summaries(rows).select("video_id", "player_id", F.col("jersey").alias("number"))


@query("f6_windowed_means", sql("""SELECT video_id, player_id, frame_id, round(avg(CAST(embedding[1] AS DOUBLE)) OVER w, 6) AS m0, round(avg(CAST(embedding[64] AS DOUBLE)) OVER w, 6) AS m63, count(*) OVER w AS n
 FROM (SELECT *, CAST((frame_id - frame_id % 20) / 20 AS BIGINT) AS video_id FROM vectors) WINDOW w AS (PARTITION BY video_id, player_id ORDER BY frame_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", "vectors"))
def f6(t: Tables) -> DataFrame:
    rows = t.vectors.withColumn("video_id", F.expr("CAST((frame_id - frame_id % 20) / 20 AS BIGINT)"))
    m = V.windowed_means(rows, ["video_id", "player_id"], "frame_id", "embedding", 3)
    return m.select("video_id", "player_id", "frame_id", F.round(F.get("mean", F.lit(0)), 6).alias("m0"), F.round(F.get("mean", F.lit(63)), 6).alias("m63"), "n")


@query("f7_robust_distances", sql(f"""WITH d AS (SELECT a.player_id AS a, b.player_id AS b, {_COS} AS d FROM vectors a JOIN vectors b ON a.player_id < b.player_id AND a.label = b.label AND a.frame_id - b.frame_id BETWEEN -8 AND 8)
SELECT a, b, round(quantile_cont(d, 0.1), 5) AS d FROM d GROUP BY 1, 2""", "vectors"))
def f7_robust(t: Tables) -> DataFrame:
    """The tenth percentile of the distances between two galleries, for vectors near in time with one label."""
    from ..operators.relops import band_join

    v = t.vectors.select("player_id", "label", "frame_id", "embedding")
    pairs = band_join(v.withColumnRenamed("player_id", "a"), v.selectExpr("player_id AS b", "label", "frame_id AS f2", "embedding AS e2"), ["label"], "frame_id", "f2", -8, 8).where("a < b")
    return _round(stitch.robust_distances(pairs.select("a", "b", V.cosine_distance(F.col("embedding"), F.col("e2")).alias("d")), ["a", "b"], 0.1), "d", places=5)


# -- detectors -----------------------------------------------------------------------------------------------------------------

_CONF = "CAST((x1 * 31 + y1) % 1000 AS DOUBLE) / 1000"
#: Detections as predictions beside the players: moved boxes with a confidence and, for E18's sake, classes of their own.
_PRED = f"pred AS (SELECT video_id, frame_id, det_idx, x1, y1, x2, y2, {_CONF} AS confidence FROM poses)"
#: Greedy matching at each limit: a walk over an image's predictions by falling confidence, with what is taken.
_WALK = f"""lim AS (SELECT (50 + 5 * i) / 100e0 AS iou FROM (SELECT unnest(range(0, {{n}})) AS i)),
near AS (SELECT p.video_id, p.frame_id, p.det_idx, list({{{{'o': {_iou('p', 'g')}, 'i': g.det_idx}}}} ORDER BY {_iou('p', 'g')} DESC, g.det_idx) AS near FROM pred p JOIN players g USING (video_id, frame_id) WHERE {_iou('p', 'g')} >= 0.5 GROUP BY 1, 2, 3),
ranked AS (SELECT p.*, coalesce(near, []) AS near, row_number() OVER (PARTITION BY p.video_id, p.frame_id ORDER BY confidence DESC, det_idx) AS r FROM pred p LEFT JOIN near USING (video_id, frame_id, det_idx)),
walk AS (SELECT DISTINCT video_id, frame_id, iou, 0 AS r, [] :: BIGINT[] AS taken, CAST(NULL AS BIGINT) AS det_idx, CAST(NULL AS DOUBLE) AS confidence, FALSE AS hit FROM pred, lim
 UNION ALL SELECT w.video_id, w.frame_id, w.iou, d.r, CASE WHEN coalesce(list_filter(d.near, lambda k: NOT list_contains(w.taken, k.i))[1].o >= w.iou, FALSE) THEN list_append(w.taken, list_filter(d.near, lambda k: NOT list_contains(w.taken, k.i))[1].i) ELSE w.taken END,
  d.det_idx, d.confidence, coalesce(list_filter(d.near, lambda k: NOT list_contains(w.taken, k.i))[1].o >= w.iou, FALSE)
  FROM walk w JOIN ranked d ON d.video_id = w.video_id AND d.frame_id = w.frame_id AND d.r = w.r + 1),
m AS (SELECT * FROM walk WHERE r > 0), total AS (SELECT count(*) AS total FROM players),
curve AS (SELECT iou, confidence, sum(CASE WHEN hit THEN 1e0 ELSE 0e0 END) OVER w / count(*) OVER w AS precision, sum(CASE WHEN hit THEN 1e0 ELSE 0e0 END) OVER w / total AS recall
 FROM m, total WINDOW w AS (PARTITION BY iou ORDER BY confidence DESC, video_id, frame_id, det_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT iou, avg(p) AS ap FROM (SELECT l.iou, g.t, coalesce((SELECT max(precision) FROM curve c WHERE c.iou = l.iou AND floor(c.recall * 100 + 1e-9) >= g.t), 0) AS p FROM lim l, (SELECT unnest(range(0, 101)) AS t) g) GROUP BY 1)"""


def _evaluation(body: str, limits: int) -> str:
    return sql(f"WITH {_POSES}, {_PRED}, {_WALK.format(n=limits)} {body}", "players", recursive=True)


def _pred(t: Tables) -> DataFrame:
    return _poses(t).withColumn("confidence", F.expr(_CONF))


@query("f9_detection_scores", _evaluation("""SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1
 FROM (SELECT CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS fp, (SELECT total FROM total) - CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM m)""", 1))
def f9(t: Tables) -> DataFrame:
    return _round(metrics.detection_scores(t.players, _pred(t)), "precision", "recall", "f1")


@query("f10_detection_ap", _evaluation("SELECT round(ap, 6) AS ap FROM ap", 1))
def f10(t: Tables) -> DataFrame:
    return _round(metrics.average_precision_at(t.players, _pred(t), 0.5), "ap")


@query("f11_mean_average_precision", _evaluation("SELECT iou, round(ap, 6) AS ap FROM ap UNION ALL SELECT NULL, round(avg(ap), 6) FROM ap", 10))
def f11(t: Tables) -> DataFrame:
    return _round(metrics.mean_average_precision(t.players, _pred(t)), "ap")


@query("f14_coco_summary", _evaluation("""SELECT round((SELECT avg(ap) FROM ap), 6) AS ap, round((SELECT ap FROM ap WHERE iou = 0.5), 6) AS ap50, round((SELECT ap FROM ap WHERE iou = 0.75), 6) AS ap75,
 round((SELECT sum(r) / 10 FROM (SELECT max(recall) AS r FROM curve GROUP BY iou)), 6) AS ar, round((SELECT max(2 * precision * recall / (precision + recall)) FROM curve WHERE iou = 0.5 AND precision + recall > 0), 6) AS max_f1""", 10))
def f14(t: Tables) -> DataFrame:
    return _round(metrics.coco_summary(t.players, _pred(t)).drop("max_f1_confidence"), "ap", "ap50", "ap75", "ar", "max_f1")


@query("f13_true_positives", sql(f"""WITH {_POSES}, {_PRED}, near AS (SELECT p.video_id, p.frame_id, p.det_idx, g.det_idx AS g, {_iou('p', 'g')} AS iou FROM pred p JOIN players g USING (video_id, frame_id) WHERE {_iou('p', 'g')} >= 0.5),
one AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, det_idx ORDER BY iou DESC, g) = 1), best AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, g ORDER BY iou DESC, det_idx) = 1)
SELECT p.video_id, p.frame_id, p.det_idx, (SELECT string_agg(CASE WHEN coalesce(b.iou, 0) >= (50 + 5 * i) / 100e0 THEN '1' ELSE '0' END, '' ORDER BY i) FROM (SELECT unnest(range(0, 10)) AS i)) AS hits FROM pred p LEFT JOIN best b USING (video_id, frame_id, det_idx)""", "players"))
def f13(t: Tables) -> DataFrame:
    m = metrics.true_positives(t.players, _pred(t))
    return m.select(*FRAME, "det_idx", F.array_join(F.transform("hits", lambda h: h.cast("int").cast("string")), "").alias("hits"))


@query("f12_detector_report", sql("""SELECT kind, n - miss AS tp, miss AS fn, round((n - miss) / CAST(n AS DOUBLE), 6) AS recall, 1e0 AS precision FROM (SELECT CASE WHEN class_id = 0 THEN 'ball' WHEN class_id = 10 THEN 'rim' ELSE 'player' END AS kind, count(*) AS n,
 CAST(sum(CASE WHEN (frame_id + det_idx) % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS miss FROM det WHERE class_id BETWEEN 2 AND 8 OR class_id IN (0, 10) GROUP BY 1)""", "det"))
def f12(t: Tables) -> DataFrame:
    """Predictions are the boxes themselves, some missing."""
    kinds = {k: detect.CLASSES[k] for k in ("player", "ball", "rim")}
    return _round(metrics.detector_report(t.det, t.det.where("(frame_id + det_idx) % 6 <> 0"), kinds).select("kind", "tp", "fn", "recall", "precision"), "recall", "precision")


@query("o17_model_predictions", sql("SELECT video_id, frame_id, det_idx, CAST(CASE class_id WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END AS BIGINT) AS class_id, confidence, CAST(trunc(x1 + 0.7e0) AS BIGINT) AS x1, CAST(trunc(y1 + 0.2e0) AS BIGINT) AS y1, CAST(trunc(x2 + 0.9e0) AS BIGINT) AS x2, y2 FROM det WHERE class_id IN (0, 1, 10)", "det"))
def o17(t: Tables) -> DataFrame:
    """Another model's output: its names, fractions of pixels, its classes."""
    raw = t.det.where("class_id IN (0, 1, 2, 10)").selectExpr("video_id AS clip", "frame_id AS n", "det_idx AS i", "CAST(class_id AS INT) AS label", "confidence AS score", "x1 + 0.7D AS left", "y1 + 0.2D AS top", "x2 + 0.9D AS right", "y2 + 0D AS bottom")
    names = {"clip": "video_id", "n": "frame_id", "i": "det_idx", "label": "class_id", "score": "confidence", "left": "x1", "top": "y1", "right": "x2", "bottom": "y2"}
    return readers.predictions(raw, names, {0: 0, 1: 2, 10: 5})


# -- segments and tracks -------------------------------------------------------------------------------------------------------


@query("e18_segment_scores", sql("""WITH g AS (SELECT video_id, frame_id AS s, frame_id + 9 AS e FROM balls WHERE frame_id % 12 = 0), p AS (SELECT video_id, s + video_id % 5 + s % 5 AS s, e + video_id % 5 AS e FROM g WHERE s % 36 <> 0 UNION ALL SELECT video_id, s + 400, e + 400 FROM g WHERE s % 60 = 0),
h AS (SELECT p.video_id, p.s, count(g.s) AS hit FROM p LEFT JOIN g ON p.video_id = g.video_id AND (least(p.e, g.e) - greatest(p.s, g.s) + 1) / CAST((p.e - p.s + 1) + (g.e - g.s + 1) - (least(p.e, g.e) - greatest(p.s, g.s) + 1) AS DOUBLE) >= 0.5 AND least(p.e, g.e) >= greatest(p.s, g.s) GROUP BY 1, 2)
SELECT 'shot' AS cls, tp, fp, fn, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT CAST(sum(hit) AS BIGINT) AS tp, count(*) - CAST(sum(hit) AS BIGINT) AS fp, (SELECT count(*) FROM g) - CAST(sum(hit) AS BIGINT) AS fn FROM h)""", "balls"))
def e18(t: Tables) -> DataFrame:
    """Segments apart from each other, so a prediction meets one of them at most."""
    g = t.balls.where("frame_id % 12 = 0").selectExpr("video_id AS clip", "'shot' AS cls", "frame_id AS s", "frame_id + 9 AS e")
    p = g.where("s % 36 <> 0").selectExpr("clip", "cls", "s + clip % 5 + s % 5 AS s", "e + clip % 5 AS e").unionAll(g.where("s % 60 = 0").selectExpr("clip", "cls", "s + 400", "e + 400"))
    return _round(metrics.segment_f1(g, p, 0.5).select("cls", "tp", "fp", "fn", "f1"), "f1")


@query("o11_event_segments", sql(f"WITH {SHOTS} SELECT video_id, 'shot' AS cls, start_frame, end_frame FROM shots UNION ALL SELECT video_id, 'make', make_start, make_end FROM shots WHERE is_make", "labels"))
def o11(t: Tables) -> DataFrame:
    return shots.shot_segments(shots.shot_events(t.labels))


@query("f15_track_scores", sql("""WITH g AS (SELECT *, frame_id % 100 < 50 AS early FROM players), p AS (SELECT *, lag(early) OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS was FROM g WHERE frame_id % 17 <> 0),
n AS (SELECT video_id, count(*) AS gt FROM g GROUP BY 1), k AS (SELECT video_id, player_id, early, count(*) AS c FROM p GROUP BY 1, 2, 3), gk AS (SELECT video_id, player_id, count(*) AS g FROM g GROUP BY 1, 2),
s AS (SELECT video_id, count(*) AS tp, CAST(sum(CASE WHEN was <> early THEN 1 ELSE 0 END) AS BIGINT) AS idsw FROM p GROUP BY 1), i AS (SELECT video_id, sum(m) AS idtp FROM (SELECT video_id, player_id, max(c) AS m FROM k GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT k.video_id, sum(CAST(c AS DOUBLE) * c / (gk.g + c - c)) AS ass FROM k JOIN gk USING (video_id, player_id) GROUP BY 1)
SELECT video_id, CAST(tp AS DOUBLE) AS tp, 0e0 AS fp, CAST(gt - tp AS DOUBLE) AS fn, CAST(idsw AS DOUBLE) AS idsw, round((tp - idsw) / CAST(gt AS DOUBLE), 6) AS mota, 1e0 AS motp, CAST(idtp AS DOUBLE) AS idtp, round(2e0 * idtp / (gt + tp), 6) AS idf1,
 round(sqrt(tp / CAST(gt AS DOUBLE) * (ass / tp)), 6) AS hota, round(tp / CAST(gt AS DOUBLE), 6) AS deta, round(ass / tp, 6) AS assa FROM n JOIN s USING (video_id) JOIN i USING (video_id) JOIN a USING (video_id)""", "players"))
def f15(t: Tables) -> DataFrame:
    """Predictions are the boxes themselves under ids that change every 50 frames, without each 17th frame."""
    gt = t.players.withColumnRenamed("player_id", "id")
    pred = gt.withColumn("id", F.expr("CASE WHEN frame_id % 100 < 50 THEN id ELSE id + 10 END")).where("frame_id % 17 <> 0")
    s = metrics.track_scores(gt, pred)
    return _round(s.select("video_id", "tp", "fp", "fn", "idsw", "mota", "motp", "idtp", "idf1", "hota", "deta", "assa"), "mota", "motp", "idf1", "hota", "deta", "assa")


@query("f17_overall_scores", sql("""WITH g AS (SELECT *, frame_id % 100 < 50 AS early FROM players), p AS (SELECT *, lag(early) OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS was FROM g WHERE frame_id % 17 <> 0),
n AS (SELECT count(*) AS gt, count(DISTINCT video_id) AS videos FROM g), s AS (SELECT count(*) AS tp, sum(CASE WHEN was <> early THEN 1 ELSE 0 END) AS idsw FROM p)
SELECT round((tp - idsw) / CAST(gt AS DOUBLE), 6) AS mota, 1e0 AS motp, videos FROM n, s""", "players"))
def f17(t: Tables) -> DataFrame:
    gt = t.players.withColumnRenamed("player_id", "id")
    pred = gt.withColumn("id", F.expr("CASE WHEN frame_id % 100 < 50 THEN id ELSE id + 10 END")).where("frame_id % 17 <> 0")
    return _round(metrics.overall(metrics.track_scores(gt, pred)).select("mota", "motp", "videos"), "mota", "motp")


@query("f18_remapped_ids", sql("""WITH q AS (SELECT video_id, frame_id, det_idx, CASE WHEN frame_id % 10 < 7 THEN (player_id * 5 + 3) % 17 ELSE 40 + player_id END AS id, player_id FROM players),
k AS (SELECT video_id, id, player_id, count(*) AS n FROM q GROUP BY 1, 2, 3), best AS (SELECT video_id, id, player_id FROM k WHERE id < 40),
fresh AS (SELECT video_id, id, 8 + row_number() OVER (PARTITION BY video_id ORDER BY id) AS new_id FROM (SELECT DISTINCT video_id, id FROM q WHERE id >= 40))
SELECT q.video_id, q.frame_id, q.id, coalesce(b.player_id, f.new_id) AS new_id FROM q LEFT JOIN best b ON q.video_id = b.video_id AND q.id = b.id LEFT JOIN fresh f ON q.video_id = f.video_id AND q.id = f.id""", "players"))
def f18(t: Tables) -> DataFrame:
    """Each player has an id for seven frames of ten, which goes to the player's own, and another for the rest, which gets a fresh one."""
    gt = t.players.select(*FRAME, F.col("player_id").alias("id"), "x1", "y1", "x2", "y2")
    pred = gt.withColumn("id", F.expr("CASE WHEN frame_id % 10 < 7 THEN (id * 5 + 3) % 17 ELSE 40 + id END"))
    return metrics.remap_ids(gt, pred, 0.9).select(*FRAME, "id", "new_id")


@query("g18_clips", sql("""SELECT v.video_id, f AS slot, CASE WHEN (frame_id * 7 + v.video_id) % 10 < 3 THEN NULL ELSE frame_id END AS frame_id, coalesce((frame_id * 7 + v.video_id) % 10 >= 3, FALSE) AS there
FROM (SELECT video_id, unnest(range(0, 48)) AS f FROM (SELECT DISTINCT video_id FROM balls WHERE frame_id BETWEEN 20 AND 59)) v LEFT JOIN (SELECT video_id, frame_id FROM balls WHERE frame_id BETWEEN 20 AND 59) s ON s.video_id = v.video_id AND s.frame_id = f + 20""", "balls"))
def g18(t: Tables) -> DataFrame:
    """Clips of 40 frames without some of them, padded to 48."""
    clips = smooth.padded_clips(t.balls.select(*FRAME), F.lit(20).cast("long"), 40, 48, F.expr("(frame_id * 7 + video_id) % 10 < 3"))
    return clips.select("video_id", "slot", "frame_id", "there")


@query("f24_coverage", sql("SELECT video_id, count(DISTINCT frame_id) AS frames, count(DISTINCT class_id) AS classes, count(*) AS boxes FROM det GROUP BY 1", "det"))
def f24(t: Tables) -> DataFrame:
    return metrics.coverage(t.det)


@query("m5_evaluated", sql("SELECT video_id, frame_id, det_idx, CASE WHEN det_idx % 4 = 0 THEN -1 ELSE player_id END AS id FROM players WHERE det_idx % 4 <> 0", "players"))
def m5(t: Tables) -> DataFrame:
    return T.evaluated(t.players.selectExpr(*FRAME, "det_idx", "CASE WHEN det_idx % 4 = 0 THEN -1 ELSE player_id END AS player_id"))


# -- identities of players that move smoothly and look alike over time: each has one id, and each id one player ----------------


def _smooth(t: Tables) -> DataFrame:
    """Players in lanes with their own vectors, numbers and places on the court; every eleventh row is missing."""
    step = F.expr("abs(frame_id % 100 - 50)")
    x1, y1 = 100 + (F.col("det_idx") - 4) * 220 + step, 300 + (F.col("det_idx") * 53) % 300 + step
    one = F.expr("transform(sequence(4, 11), i -> CASE WHEN i = det_idx THEN 1D ELSE 0.05D * (frame_id % 3) END)")
    rows = t.players.where("(frame_id * 8 + det_idx) % 11 <> 0").select(*FRAME, "det_idx", F.col("player_id").alias("truth"), x1.alias("x1"), y1.alias("y1"), (x1 + 60).alias("x2"), (y1 + 140).alias("y2"), "confidence")
    placed = rows.withColumn("court_x", (F.col("x1") + 30) / WIDTH * 28 - 14).withColumn("court_y", F.col("y2") / HEIGHT * 15 - 7.5)
    return placed.withColumn("color", one).withColumn("reid", one).withColumn("num", F.expr("CASE WHEN frame_id % 4 = 0 THEN det_idx + 10 END"))


def _identities(rows: DataFrame) -> DataFrame:
    """For each player its rows that have an id, how many ids they have, and how many players share those."""
    shared = F.size(F.collect_set("truth").over(Window.partitionBy("video_id", "player_id")))
    known = rows.where("player_id >= 1").withColumn("players", shared.cast("long"))
    return known.groupBy("video_id", "truth").agg(F.count("*").alias("n"), F.countDistinct("player_id").alias("ids"), F.max("players").alias("players"))


def _nearly_all(t: Tables, each: DataFrame) -> DataFrame:
    """Whether a player's rows have an id but for five, as tracks begin and end with a few that have none, however long the video is."""
    total = _smooth(t).groupBy("video_id", "truth").agg(F.count("*").alias("total"))
    return each.join(total, ["video_id", "truth"]).select("video_id", "truth", "ids", "players", (F.col("total") - F.col("n") <= 5).alias("nearly_all"))


def _expected(where: str) -> str:
    return sql(f"SELECT video_id, player_id AS truth, count(*) AS n, CAST(1 AS BIGINT) AS ids, CAST(1 AS BIGINT) AS players FROM players WHERE (frame_id * 8 + det_idx) % 11 <> 0 AND {where} GROUP BY 1, 2", "players")


@query("i2_flow_known", _expected("TRUE").replace("count(*) AS n", "TRUE AS nearly_all"))
def i2_known(t: Tables) -> DataFrame:
    """The flow tracker's defaults with vectors: extended costs, skips and occlusion links take part."""
    return _nearly_all(t, _identities(tracking.track_flow(_smooth(t), FPS, tracking.FlowConfig(tracks=8))))


@query("i6_court_known", _expected("TRUE").replace("count(*) AS n", "TRUE AS nearly_all"))
def i6_known(t: Tables) -> DataFrame:
    """The court tracker with vectors; rows before a track is confirmed have no id."""
    return _nearly_all(t, _identities(tracking.track_court(_smooth(t))))


@query("i9_appearance_known", _expected("TRUE"))
def i9_known(t: Tables) -> DataFrame:
    return _identities(tracking.track_appearance(_smooth(t).withColumn("player_id", F.lit(-1).cast("long"))))


@query("i11_stitched_known", _expected("frame_id % 90 < 80"))
def i11_known(t: Tables) -> DataFrame:
    """Tracks that break off every 90 frames, stitched by place, vectors and numbers."""
    broken = _smooth(t).where("frame_id % 90 < 80").withColumn("player_id", F.expr("1 + truth + 10 * CAST((frame_id - frame_id % 90) / 90 AS BIGINT)"))
    return _identities(stitch.stitch(broken, FPS, stitch.StitchConfig(players=8)))


# -- the court -----------------------------------------------------------------------------------------------------------------

def _cofactors() -> str:
    """The inverse of a matrix (a..j) as the scalar function has it: nine cofactors over the determinant."""
    det = "(a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g))"
    cof = ["e * j - f * i", "c * i - b * j", "b * f - c * e", "f * g - d * j", "a * j - c * g", "c * d - a * f", "d * i - e * g", "b * g - a * i", "a * e - b * d"]
    return ", ".join(f"({x}) / {det} AS i{k}" for k, x in enumerate(cof))


_HM = "hm AS (SELECT video_id, frame_id, 1e0 AS a, 0e0 AS b, k * 0.001e0 - 0.5e0 AS c, 0e0 AS d, 1e0 AS e, -0.5e0 AS f, 0e0 AS g, m * 0.05e0 AS i, 1e0 AS j FROM homographies)"


def _points_sql(name: str) -> str:
    length, width = court.SIZES[name]
    rows = ", ".join(f"({i}, {x!r}e0 / {length!r}e0, {y!r}e0 / {width!r}e0)" for i, x, y in ((i, float(x), float(y)) for i, x, y in court.court_points(name)))
    return f"pt(point, u, v) AS (VALUES {rows})"


_SLOTS = f"""{_HM}, {_points_sql("nba")}, iv AS (SELECT video_id, frame_id, {_cofactors()} FROM hm),
sl AS (SELECT video_id, frame_id, point, (i0 * u + i1 * v + i2) / (i6 * u + i7 * v + i8) AS px, (i3 * u + i4 * v + i5) / (i6 * u + i7 * v + i8) AS py FROM iv, pt WHERE abs(i6 * u + i7 * v + i8) > 1e-8),
slots AS (SELECT * FROM sl WHERE px BETWEEN 0 AND 1 AND py BETWEEN 0 AND 1)"""


@query("c12_keypoint_slots", sql(f"WITH {_SLOTS} SELECT video_id, frame_id, point, round(px, 6) AS px, round(py, 6) AS py FROM slots", "homographies"))
def c12(t: Tables) -> DataFrame:
    return _round(court.keypoint_slots(_homographies(t), "nba").select(*FRAME, "point", "px", "py"), "px", "py")


@query("a21_keypoint_labels", sql(f"WITH {_SLOTS} SELECT video_id, frame_id, CAST(point - 10 AS BIGINT) AS class_id, round(px, 6) AS px, round(py, 6) AS py, 0.02e0 AS w FROM slots WHERE px BETWEEN 0.05 AND 0.95 AND py BETWEEN 0.05 AND 0.95 AND point BETWEEN 10 AND 20", "homographies"))
def a21(t: Tables) -> DataFrame:
    """Homographies to labels: the model's points in the picture as small boxes, under a data set's own class ids."""
    slots = court.keypoint_slots(_homographies(t), "nba")
    got = readers.keypoint_labels(slots, 0.02, 0.05, {i: i - 10 for i in range(10, 21)})
    return _round(got.select(*FRAME, "class_id", "px", "py", "w"), "px", "py")


@query("c14_frame_embeddings", sql(f"""WITH {_SLOTS}, fr AS (SELECT DISTINCT video_id, frame_id FROM det),
rim AS (SELECT *, CASE WHEN x1 / 1920e0 < 0.5 THEN 3 ELSE 8 END AS o FROM det WHERE class_id = 10 QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, x1 / 1920e0 < 0.5 ORDER BY confidence DESC, det_idx) = 1),
parts AS (SELECT video_id, frame_id, 0 + i AS i, [(x1 + x2) / 2e0 / 1920, (y1 + y2) / 2e0 / 1080, confidence][i + 1] AS x FROM balls, LATERAL (SELECT unnest(range(0, 3)) AS i)
 UNION ALL SELECT video_id, frame_id, o + i, [CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE), CAST(x2 AS DOUBLE), CAST(y2 AS DOUBLE), confidence][i + 1] FROM rim, LATERAL (SELECT unnest(range(0, 5)) AS i)
 UNION ALL SELECT video_id, frame_id, 13 + 3 * point + i, [px, py, 1e0][i + 1] FROM slots, LATERAL (SELECT unnest(range(0, 3)) AS i))
SELECT video_id, frame_id, CAST(i AS INTEGER) AS i, round(x, 9) AS x FROM parts JOIN fr USING (video_id, frame_id) WHERE round(x, 9) <> 0""", "balls", "homographies"))
def c14(t: Tables) -> DataFrame:
    """The 112 numbers of each frame, as rows where they aren't 0."""
    b = t.balls.select(*FRAME, ((F.col("x1") + F.col("x2")) / 2 / WIDTH).alias("bx"), ((F.col("y1") + F.col("y2")) / 2 / HEIGHT).alias("by"), F.col("confidence").alias("conf"))
    rims = detect.left_right_rims(t.det.where("class_id = 10").withColumn("court_x", F.lit(None).cast("double")).withColumn("x_rel", F.col("x1") / WIDTH))
    e = court.frame_embedding(t.det.select(*FRAME).distinct(), b, rims, court.keypoint_slots(_homographies(t), "nba"))
    return _round(e.select(*FRAME, F.posexplode("embedding").alias("i", "x")), "x", places=9).where("x <> 0")


@query("f22_grid_errors", sql(f"""WITH {_HM}, iv AS (SELECT *, {_cofactors()} FROM hm), cell AS (SELECT (n % 20) / 19e0 - 0.5e0 AS u, floor(n / 20e0) / 19e0 - 0.5e0 AS v FROM (SELECT unnest(range(0, 400)) AS n)),
sh AS (SELECT *, (i0 * u + i1 * v + i2) / (i6 * u + i7 * v + i8) AS px, (i3 * u + i4 * v + i5) / (i6 * u + i7 * v + i8) AS py FROM iv, cell),
er AS (SELECT video_id, sqrt(pow((u - (a * px + b * py + (c + 0.002e0)) / (g * px + i * py + j)) * 28.65e0, 2) + pow((v - (d * px + e * py + f) / (g * px + i * py + j)) * 15.24e0, 2)) AS er FROM sh WHERE px BETWEEN 0 AND 1 AND py BETWEEN 0 AND 1)
SELECT video_id, grouping(video_id) = 1 AS overall, round(sqrt(avg(er * er)), 6) AS rmse, round(avg(er), 6) AS mean, round(median(er), 6) AS median, count(*) AS points FROM er GROUP BY ROLLUP (video_id)""", "homographies"))
def f22(t: Tables) -> DataFrame:
    h = _homographies(t)
    pairs = h.withColumnRenamed("h", "gt").withColumn("pred", F.transform("gt", lambda x, i: F.when(i == 2, x + 0.002).otherwise(x)))
    return _round(court.error_summary(court.grid_errors(pairs, "nba")), "rmse", "mean", "median")


#: Positions with outliers and gaps, the filter's steps forward and the smoother's back; the two axes have the same 2 x 2 covariances.
_KALMAN = f"""{_COURT}, cl AS (SELECT video_id, player_id, frame_id, row_number() OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS t,
 CASE WHEN abs(y2 - median(y2) OVER (PARTITION BY video_id, player_id ORDER BY frame_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) > 30 THEN NULL ELSE court_x END AS ox,
 CASE WHEN abs(y2 - median(y2) OVER (PARTITION BY video_id, player_id ORDER BY frame_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) > 30 THEN NULL ELSE court_y END AS oy FROM court),
ob AS (SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY t) AS k FROM cl WHERE ox IS NOT NULL),
st AS (SELECT a.video_id, a.player_id, a.ox AS x, b.ox - a.ox AS vx, a.oy AS y, b.oy - a.oy AS vy FROM ob a JOIN ob b ON a.video_id = b.video_id AND a.player_id = b.player_id AND a.k = 1 AND b.k = 2),
fw AS (SELECT video_id, player_id, CAST(0 AS BIGINT) AS t, x, vx, y, vy, 0.1e0 AS p, 0e0 AS c, 0.5e0 AS v, x AS x0, vx AS vx0, y AS y0, vy AS vy0, 1e0 AS p0, 0e0 AS c0, 1e0 AS v0 FROM st
 UNION ALL SELECT video_id, player_id, t, x0 + p0 / (p0 + 0.1e0) * coalesce(ox - x0, 0), vx0 + c0 / (p0 + 0.1e0) * coalesce(ox - x0, 0), y0 + p0 / (p0 + 0.1e0) * coalesce(oy - y0, 0), vy0 + c0 / (p0 + 0.1e0) * coalesce(oy - y0, 0),
  (1 - p0 / (p0 + 0.1e0)) * p0, (1 - p0 / (p0 + 0.1e0)) * c0, v0 - c0 / (p0 + 0.1e0) * c0, x0, vx0, y0, vy0, p0, c0, v0
  FROM (SELECT fw.video_id, fw.player_id, cl.t, cl.ox, cl.oy, x + vx AS x0, vx AS vx0, y + vy AS y0, vy AS vy0, p + 2 * c + v + 0.01e0 AS p0, c + v AS c0, v + 0.1e0 AS v0 FROM fw JOIN cl ON cl.video_id = fw.video_id AND cl.player_id = fw.player_id AND cl.t = fw.t + 1)),
kept AS (SELECT *, max(t) OVER (PARTITION BY video_id, player_id) AS n FROM fw WHERE t > 0),
gain AS (SELECT a.*, b.x0 AS nx, b.vx0 AS nvx, b.y0 AS ny, b.vy0 AS nvy, ((a.p + a.c) * b.v0 - a.c * b.c0) / (b.p0 * b.v0 - b.c0 * b.c0) AS j11, (a.c * b.p0 - (a.p + a.c) * b.c0) / (b.p0 * b.v0 - b.c0 * b.c0) AS j12,
 ((a.c + a.v) * b.v0 - a.v * b.c0) / (b.p0 * b.v0 - b.c0 * b.c0) AS j21, (a.v * b.p0 - (a.c + a.v) * b.c0) / (b.p0 * b.v0 - b.c0 * b.c0) AS j22 FROM kept a JOIN kept b ON a.video_id = b.video_id AND a.player_id = b.player_id AND b.t = a.t + 1),
bw AS (SELECT video_id, player_id, t, x, vx, y, vy FROM kept WHERE t = n
 UNION ALL SELECT g.video_id, g.player_id, g.t, g.x + j11 * (bw.x - nx) + j12 * (bw.vx - nvx), g.vx + j21 * (bw.x - nx) + j22 * (bw.vx - nvx), g.y + j11 * (bw.y - ny) + j12 * (bw.vy - nvy), g.vy + j21 * (bw.y - ny) + j22 * (bw.vy - nvy)
  FROM bw JOIN gain g ON g.video_id = bw.video_id AND g.player_id = bw.player_id AND g.t = bw.t - 1)"""


@query("g11_smooth_positions", sql(f"WITH {_KALMAN} SELECT cl.video_id, cl.frame_id, cl.player_id, round(bw.x + 1e-9, 6) AS court_x, round(bw.y + 1e-9, 6) AS court_y FROM bw JOIN cl ON cl.video_id = bw.video_id AND cl.player_id = bw.player_id AND cl.t = bw.t", "players", "homographies", recursive=True))
def g11(t: Tables) -> DataFrame:
    """Every third frame has no position; the smoother gives one."""
    got = smooth.smooth_positions(_court(t)).select(*FRAME, "player_id", "court_x", "court_y")
    return got.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("court_x", "court_y")})


@query("e16_optimal_pairs", sql(f"WITH {_POSES} SELECT p.video_id, p.frame_id, p.player_id AS gt_id, q.det_idx AS pred_id FROM players p JOIN poses q ON p.video_id = q.video_id AND p.frame_id = q.frame_id AND q.det_idx = 11 - p.det_idx WHERE {_iou('p', 'q')} >= 0.3", "players"))
def e16(t: Tables) -> DataFrame:
    """Poses are moved boxes of the players: each one's own is its best."""
    return metrics.optimal_frame_pairs(t.players.withColumnRenamed("player_id", "id"), _poses(t).withColumn("id", F.col("det_idx")), 0.3)


# -- the ball ------------------------------------------------------------------------------------------------------------------


@query("d12_ball_chain", sql("""WITH c AS (SELECT video_id, frame_id, det_idx, (x1 + x2) / 2e0 / 1920 AS x, (y1 + y2) / 2e0 / 1080 AS y, 0.02e0 * 0 - 0.01e0 * confidence AS own, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_id) AS i FROM det WHERE det_idx IN (0, 3) AND confidence >= 0.3),
g AS (SELECT video_id, i, list({'x': x, 'y': y, 'own': own, 'key': frame_id * 100 + det_idx} ORDER BY det_idx) AS c FROM c GROUP BY 1, 2), n AS (SELECT video_id, max(i) AS n FROM g GROUP BY 1),
w AS (SELECT video_id, CAST(0 AS BIGINT) AS i, [] :: STRUCT(i BIGINT, x DOUBLE, y DOUBLE, cost DOUBLE, path BIGINT[])[] AS st FROM n
 UNION ALL SELECT w.video_id, g.i, list_concat(list_filter(w.st, lambda e: e.i >= g.i - 50), list_transform(g.c, lambda k: list_transform(list_sort(list_concat(
   CASE WHEN g.i <= 50 THEN [{'t': (g.i - 1) * 0.5e0 + k.own, 'o': -1, 'path': [] :: BIGINT[]}] ELSE [] END,
   list_transform(list_filter(w.st, lambda e: e.i >= g.i - 50), lambda e, o: {'t': e.cost + (g.i - e.i - 1) * 0.5e0 + 3e0 * sqrt(pow(k.x - e.x, 2) + pow(k.y - e.y, 2)) + k.own, 'o': CAST(o AS INTEGER), 'path': e.path}))),
   lambda b: {'i': g.i, 'x': k.x, 'y': k.y, 'cost': b.t, 'path': list_append(b.path, k.key)})[1]))
 FROM w JOIN g ON g.video_id = w.video_id AND g.i = w.i + 1),
fin AS (SELECT w.video_id, list_sort(list_transform(list_filter(w.st, lambda e: e.i >= n.n + 1 - 50), lambda e, o: {'t': e.cost + (n.n - e.i) * 0.5e0, 'o': o, 'path': e.path}))[1].path AS path FROM w JOIN n ON n.video_id = w.video_id AND n.n = w.i)
SELECT video_id, CAST((k - k % 100) / 100 AS BIGINT) AS frame_id, k % 100 AS det_idx FROM (SELECT video_id, unnest(path) AS k FROM fin)""", "det", recursive=True))
def d12(t: Tables) -> DataFrame:
    return ball.remove_outliers(t.det.where("det_idx in (0, 3)"), WIDTH, HEIGHT).select(*FRAME, "det_idx")


@query("i14_homographies", sql(f"""WITH {_SLOTS}, n AS (SELECT video_id, frame_id, count(*) AS n FROM slots GROUP BY 1, 2)
SELECT video_id, frame_id, {", ".join(f"CASE WHEN n >= 4 THEN round(CAST({x} AS DOUBLE), 4) END AS h{i}" for i, x in enumerate("abcdefgij"))} FROM n JOIN hm USING (video_id, frame_id)""", "homographies"))
def i14(t: Tables) -> DataFrame:
    """From a homography's own key points the homography again, in every frame that shows four of them."""
    slots = court.keypoint_slots(_homographies(t), "nba")
    pts = court.points_table(t.spark, "nba").select("point", "u", "v")
    got = court.fit_frames(slots.join(F.broadcast(pts), "point").selectExpr(*FRAME, "px AS sx", "py AS sy", "u AS dx", "v AS dy"))
    return got.select(*FRAME, *((F.round(F.get("h", F.lit(i)), 4) + 0.0).alias(f"h{i}") for i in range(9)))


@query("d13_ball_gate", sql("""WITH RECURSIVE c AS (SELECT video_id, frame_id, list({'i': det_idx, 'x': (x1 + x2) / 2e0, 'y': (y1 + y2) / 2e0, 's': confidence} ORDER BY confidence DESC, det_idx) AS c FROM det WHERE det_idx IN (0, 3) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS r FROM c),
w AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE, s DOUBLE)) AS got, CAST(NULL AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE, s DOUBLE)) AS last FROM n
 UNION ALL SELECT n.video_id, n.r, n.frame_id, list_filter(n.c, lambda k: w.last IS NULL OR pow(k.x - w.last.x, 2) + pow(k.y - w.last.y, 2) < 90000)[1], coalesce(list_filter(n.c, lambda k: w.last IS NULL OR pow(k.x - w.last.x, 2) + pow(k.y - w.last.y, 2) < 90000)[1], w.last)
 FROM w JOIN n ON n.video_id = w.video_id AND n.r = w.r + 1)
SELECT video_id, frame_id, got.x AS x, got.y AS y, got.s AS score, CAST(trunc(got.x) AS BIGINT) - 10 AS x1, CAST(trunc(got.y) AS BIGINT) - 10 AS y1, CAST(trunc(got.x) AS BIGINT) + 10 AS x2, CAST(trunc(got.y) AS BIGINT) + 10 AS y2 FROM w WHERE got IS NOT NULL""", "det").replace("WITH det", "WITH RECURSIVE det", 1).replace(",\nRECURSIVE c AS", ",\nc AS", 1))
def d13(t: Tables) -> DataFrame:
    c = t.det.where("det_idx in (0, 3)").select(*FRAME, F.col("det_idx").cast("int").alias("cand_idx"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("confidence").alias("score"))
    return ball.gated(c)


@query("g13_window_balls", sql("""SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY win) - 1 AS cand_idx, CAST(x1 + win AS DOUBLE) AS x FROM (SELECT video_id, frame_id, x1, frame_id - k AS win FROM balls, LATERAL (SELECT unnest([0, 1, 2]) AS k) WHERE frame_id - k >= 0 AND (frame_id - k) % 3 < 2)""", "balls"))
def g13(t: Tables) -> DataFrame:
    """Candidates of overlapping windows of three frames, merged by frame."""
    from ..operators.relops import band_join

    starts = t.balls.select("video_id").distinct().withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(249).cast("long")))).where("win % 3 < 2")
    near = band_join(starts, t.balls.select("video_id", "frame_id", "x1"), ["video_id"], "win", "frame_id", 0, 2)
    one = F.struct("frame_id", F.array(F.struct((F.col("x1") + F.col("win")).cast("double").alias("x"))).alias("c"))
    w = near.groupBy("video_id", F.col("win").alias("window_idx")).agg(F.array_sort(F.collect_list(one)).alias("a"))
    merged = ball.merge_windows(w.select("video_id", "window_idx", F.transform("a", lambda s: s["frame_id"]).alias("frame_ids"), F.transform("a", lambda s: s["c"]).alias("candidates")))
    return merged.select(*FRAME, "cand_idx", "x")


# -- documents and events ------------------------------------------------------------------------------------------------------

_MATES = "SELECT video_id, player_id, player_id + 10 AS track_number, player_id % 2 AS team_id FROM (SELECT DISTINCT video_id, player_id FROM players WHERE player_id <> 5)"


def _mates(t: Tables) -> DataFrame:
    return t.players.where("player_id <> 5").selectExpr("video_id", "player_id", "player_id + 10 AS track_number", "player_id % 2 AS team_id").distinct()


def _passes(t: Tables) -> DataFrame:
    return t.balls.where("frame_id % 31 = 7").selectExpr("video_id", "frame_id AS frame_start", "frame_id + det_idx + 5 AS frame_end", "1 + frame_id % 8 AS from_player", "1 + frame_id % 5 AS to_player", "frame_id % 2 AS team_id")


def _shots(t: Tables) -> DataFrame:
    return t.balls.where("frame_id % 43 = 11").selectExpr("video_id", "frame_id AS start_frame", "frame_id + 20 AS end_frame", "frame_id % 3 = 0 AS is_make", "frame_id + 5 AS make_start", "CASE WHEN frame_id % 2 = 0 THEN frame_id + 9 END AS make_end", "CASE WHEN frame_id % 4 <> 1 THEN 1 + frame_id % 8 END AS player_id")


_PASSES = f"""mates AS ({_MATES}), ps AS (SELECT video_id, frame_id AS frame_start, frame_id + det_idx + 5 AS frame_end, 1 + frame_id % 8 AS f, 1 + frame_id % 5 AS g, frame_id % 2 AS team_id FROM balls WHERE frame_id % 31 = 7)"""


@query("o12_pass_rows", sql(f"""WITH {_PASSES} SELECT ps.video_id, frame_start, frame_end, f AS from_player_id, g AS to_player_id, a.track_number AS from_track_number, b.track_number AS to_track_number, ps.team_id, round_even(frame_end / 30e0, 2) AS timestamp_sec
 FROM ps LEFT JOIN mates a ON a.video_id = ps.video_id AND a.player_id = f LEFT JOIN mates b ON b.video_id = ps.video_id AND b.player_id = g""", "players", "balls"))
def o12_passes(t: Tables) -> DataFrame:
    return sinks.pass_rows(_passes(t), _mates(t).drop("team_id"), FPS)


@query("o12_shot_rows", sql(f"""WITH mates AS ({_MATES}), sh AS (SELECT *, frame_id % 3 = 0 AND frame_id % 2 = 0 AS made, CASE WHEN frame_id % 4 <> 1 THEN 1 + frame_id % 8 END AS pid FROM balls WHERE frame_id % 43 = 11)
SELECT sh.video_id, frame_id AS frame_start, frame_id + 20 AS frame_end, frame_id % 3 = 0 AS is_make, round_even(frame_id / 30e0, 2) AS timestamp_start_sec, round_even((frame_id + 20) / 30e0, 2) AS timestamp_end_sec, pid AS shooter_player_id, m.track_number AS shooter_track_number, m.team_id AS shooter_team_id,
 CASE WHEN made THEN frame_id + 5 END AS make_start, CASE WHEN made THEN frame_id + 9 END AS make_end, CASE WHEN made THEN round_even((frame_id + 5) / 30e0, 2) END AS make_timestamp_start_sec, CASE WHEN made THEN round_even((frame_id + 9) / 30e0, 2) END AS make_timestamp_end_sec
 FROM sh LEFT JOIN mates m ON m.video_id = sh.video_id AND m.player_id = pid""", "players", "balls"))
def o12_shots(t: Tables) -> DataFrame:
    m = _mates(t)
    return sinks.shot_rows(_shots(t), m.drop("team_id"), m.drop("track_number"), FPS)


_DOC = "struct<metadata:struct<fps:double,width:int,height:int,total_frames:bigint,frame_step:int>,frames:map<string,struct<players:array<struct<player_id:int,raw_player_id:int,team_id:int,bbox:array<int>,confidence:double,jersey_number:int,jersey_confidence:double,court_position:array<double>,is_possession:boolean,track_number:int>>,balls:array<struct<bbox:array<int>,confidence:double>>>>,pass_events:array<struct<frame_end:bigint,timestamp_sec:double>>,shot_events:array<struct<frame_start:bigint>>>"


def _document(t: Tables) -> DataFrame:
    rows = t.players.withColumn("is_possession", F.col("is_dribble")).withColumn("track_number", F.col("player_id") + 10).withColumn("number", F.expr("CASE WHEN det_idx % 3 = 0 THEN x1 % 100 END")).withColumn("number_confidence", F.col("confidence") / 3)
    rows = rows.withColumn("court_x", F.expr("CASE WHEN det_idx % 2 = 0 THEN x1 / 7D END")).withColumn("court_y", F.col("y1") / 9)
    meta = t.det.groupBy("video_id").agg(F.max("frame_id").alias("m")).select("video_id", F.lit(FPS).alias("fps"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.expr("CASE WHEN video_id % 2 = 0 THEN m + 1 ELSE 0 END").alias("total_frames"))
    m = _mates(t)
    return sinks.annotation_documents(meta, rows, t.balls, sinks.pass_rows(_passes(t), m.drop("team_id"), FPS).where("video_id % 3 <> 1"), step=5)


@query("b1_document_players", sql("""SELECT video_id, frame_id, player_id, player_id AS raw_player_id, team_id, x1, y2, round_even(confidence, 4) AS confidence, CASE WHEN det_idx % 3 = 0 THEN x1 % 100 END AS jersey_number, round_even(confidence / 3, 4) AS jersey_confidence,
 CASE WHEN det_idx % 2 = 0 THEN round_even(x1 / 7e0, 3) END AS court_x, is_dribble AS is_possession, player_id + 10 AS track_number FROM players WHERE video_id % 2 = 1 OR frame_id % 5 = 0""", "players"))
def b1_players(t: Tables) -> DataFrame:
    """The documents' players, parsed again: every fifth frame of videos of known length, all that have rows of the others."""
    doc = _document(t).select("video_id", F.from_json("document", _DOC).alias("d")).select("video_id", F.explode("d.frames").alias("frame", "f"))
    p = doc.select("video_id", F.col("frame").cast("long").alias("frame_id"), F.explode("f.players").alias("p")).select("video_id", "frame_id", "p.*")
    ints = {c: F.col(c).cast("long") for c in ("player_id", "raw_player_id", "team_id", "jersey_number", "track_number")}
    return p.select("video_id", "frame_id", F.get("bbox", F.lit(0)).cast("long").alias("x1"), F.get("bbox", F.lit(3)).cast("long").alias("y2"), "confidence", "jersey_confidence", F.get("court_position", F.lit(0)).alias("court_x"), "is_possession", *(v.alias(k) for k, v in ints.items()))


@query("b1_documents", sql(f"""WITH fr AS (SELECT video_id, frame_id, count(*) AS n FROM (SELECT video_id, frame_id FROM det WHERE class_id BETWEEN 2 AND 8 OR class_id = 0) GROUP BY 1, 2), mx AS (SELECT video_id, max(frame_id) AS m FROM det GROUP BY 1),
keys AS (SELECT video_id, f AS frame_id FROM mx, LATERAL (SELECT unnest(range(0, m + 1, 5)) AS f) WHERE video_id % 2 = 0 UNION ALL SELECT video_id, frame_id FROM fr WHERE video_id % 2 = 1), {_PASSES}
SELECT video_id, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frames, max(coalesce(p.n, 0)) AS passes, max(p.t) AS last_pass, CAST(0 AS BIGINT) AS shots FROM keys LEFT JOIN (SELECT video_id, count(*) AS n, max(round_even(frame_end / 30e0, 2)) AS t FROM ps WHERE video_id % 3 <> 1 GROUP BY 1) p USING (video_id) GROUP BY 1""", "players", "balls"))
def b1_documents(t: Tables) -> DataFrame:
    """The documents' frame ids in the order they stand there, and their events; arrays of none are empty."""
    text = F.regexp_extract("document", r'"frames":(\{.*\}),"pass_events"', 1)
    ids = F.regexp_extract_all(text, F.lit(r'"(\d+)":\{"players"'), 1)
    d = F.from_json("document", _DOC)
    return _document(t).select("video_id", F.array_join(ids, ",").alias("frames"), F.size(d["pass_events"]).cast("long").alias("passes"), F.array_max(F.transform(d["pass_events"], lambda p: p["timestamp_sec"])).alias("last_pass"), F.size(d["shot_events"]).cast("long").alias("shots"))


@query("g6_densified", sql("""WITH x AS (SELECT video_id, player_id, frame_id, x1, frame_id - lag(frame_id) OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS d FROM players WHERE frame_id % 6 <> 0 AND frame_id % 90 < 60),
c AS (SELECT *, sum(CASE WHEN d <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, player_id ORDER BY frame_id) - 1 AS chunk FROM x), r AS (SELECT video_id, player_id, chunk, min(frame_id) AS a, max(frame_id) AS b FROM c GROUP BY 1, 2, 3)
SELECT r.video_id, r.player_id, CAST(r.chunk AS BIGINT) AS chunk, f AS frame_id, c.x1 FROM r, LATERAL (SELECT unnest(range(a, b + 1)) AS f) LEFT JOIN c ON c.video_id = r.video_id AND c.player_id = r.player_id AND c.frame_id = f""", "players"))
def g6_densified(t: Tables) -> DataFrame:
    rows = t.players.where("frame_id % 6 <> 0 AND frame_id % 90 < 60")
    return smooth.dense_chunks(rows.select("video_id", "player_id", "frame_id", "x1")).select("video_id", "player_id", "chunk", "frame_id", "x1")


@query("g19_remapped_frames", "WITH m AS (SELECT n_nationkey AS video_id, 60 + n_nationkey AS total FROM nation), a AS (SELECT video_id, total, f AS physical FROM m, LATERAL (SELECT unnest(range(0, total, 7)) AS f)) SELECT video_id, physical AS old, least(CAST(floor((physical + 0) / 2e0) AS BIGINT), CAST(ceil(total / 2e0) AS BIGINT) - 1) AS start_frame, CASE WHEN physical % 3 <> 0 THEN least(CAST(floor(physical / 2e0) AS BIGINT), CAST(ceil(total / 2e0) AS BIGINT) - 1) END AS shot_start_frame FROM a")
def g19(t: Tables) -> DataFrame:
    """Annotations of 60 fps videos at 30 fps: the nearest of every second frame, the smaller of two."""
    meta = t.read("nation").selectExpr("n_nationkey AS video_id", "60D AS src_fps", "60 + n_nationkey AS src_total")
    a = meta.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("src_total").cast("long") - 1, F.lit(7).cast("long"))).alias("old"))
    rows = a.select("video_id", "old", F.col("old").alias("start_frame"), F.when(F.col("old") % 3 != 0, F.col("old")).alias("shot_start_frame"))
    return T.remapped(rows, readers.frame_map(meta), ["start_frame", "shot_start_frame"]).select("video_id", "old", "start_frame", "shot_start_frame")


@query("g20_crop_labels", sql("SELECT video_id, frame_id, CASE WHEN frame_id - 40 >= 0 AND frame_id - 40 < 100 THEN frame_id - 40 END AS frame FROM balls", "balls"))
def g20(t: Tables) -> DataFrame:
    return t.balls.select(*FRAME, shots.relative(F.col("frame_id"), F.lit(40), F.lit(100)).alias("frame"))


@query("h4_active_event", sql("SELECT video_id, frame_id AS start, frame_id + 30 AS \"end\" FROM balls WHERE video_id = 0 AND frame_id <= 77 AND frame_id + 30 >= 77 ORDER BY 2, 3 LIMIT 1", "balls"))
def h4(t: Tables) -> DataFrame:
    return T.active(t.balls.where("video_id = 0").selectExpr("video_id", "frame_id AS start", "frame_id + 30 AS end"), 77)


@query("h3_event_places", sql(f"""WITH {SHOTS}, u AS (SELECT video_id, start_frame AS s, end_frame AS e, 'shot' AS kind FROM shots UNION ALL SELECT video_id, frame_id, frame_id + 4, 'pass' FROM labels WHERE frame_id % 9 = 2)
SELECT video_id, s AS start, e AS "end", kind, row_number() OVER (ORDER BY video_id, s, e, kind <> 'pass') - 1 AS place FROM u""", "labels"))
def h3_places(t: Tables) -> DataFrame:
    """The order of the events, as the place of each."""
    lab = t.labels
    got = T.game_events(lab.where("frame_id % 9 = 2").selectExpr("video_id", "frame_id AS start", "frame_id + 4 AS end"), shots.shot_events(lab).selectExpr("video_id", "start_frame AS start", "end_frame AS end"))
    return T.placed(got)


# -- jobs ----------------------------------------------------------------------------------------------------------------------

_JOBS = "SELECT 'j' || o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status, 'v' || o_custkey AS video_name, NULL AS display_name, '2024-01-' || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') AS created_at, NULL AS error FROM orders"


def _jobs(t: Tables) -> DataFrame:
    """Jobs of a table that is older than the columns display_name and error."""
    from ..schemas import JOBS

    old = t.read("orders").selectExpr("concat('j', o_orderkey) AS id", "CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status", "concat('v', o_custkey) AS video_name", "concat('2024-01-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')) AS created_at")
    return T.with_columns_of(old, JOBS)


@query("m1_migrated_jobs", _JOBS.replace("NULL AS", "CAST(NULL AS VARCHAR) AS"))
def m1(t: Tables) -> DataFrame:
    return _jobs(t)


@query("m2_job_updates", f"WITH j AS ({_JOBS.replace('NULL AS', 'CAST(NULL AS VARCHAR) AS')} UNION ALL SELECT 'j' || (1000000 + c_custkey), 'queued', c_name, c_name || '!', '2025-01-01', NULL FROM customer) SELECT id, CASE WHEN id = 'j1000001' THEN 'failed' ELSE status END AS status, video_name, display_name, created_at, CASE WHEN id = 'j1000001' THEN repeat('e', 500) END AS error FROM j")
def m2(t: Tables) -> DataFrame:
    """New jobs, and one of them that fails with a long message."""
    new = t.read("customer").selectExpr("concat('j', 1000000 + c_custkey) AS id", "c_name AS video_name", "concat(c_name, '!') AS display_name", "'2025-01-01' AS created_at")
    return T.updated(T.inserted(_jobs(t), new), "j1000001", "failed", "x" * 100 + "e" * 500)


@query("m2_comments", "SELECT row_number() OVER (ORDER BY c_custkey % 9, c_custkey) - 1 AS place, CAST(c_custkey AS INTEGER) AS id FROM customer WHERE c_custkey % 5 = 2")
def m2_comments(t: Tables) -> DataFrame:
    rows = t.read("customer").selectExpr("CAST(c_custkey AS INT) AS id", "concat('j', c_custkey % 5) AS job_id", "CAST(c_custkey % 9 AS DOUBLE) AS timestamp_sec", "c_name AS text")
    return T.placed(T.comments_of(rows, "j2").select("id"))


@query("m3_recovered_jobs", f"SELECT id, CASE WHEN status <> 'processing' THEN status WHEN CAST(substr(id, 2) AS BIGINT) % 3 = 0 THEN 'queued' ELSE 'failed' END AS status FROM ({_JOBS})")
def m3(t: Tables) -> DataFrame:
    return T.recovered(_jobs(t), t.read("orders").where("o_orderkey % 3 = 0").selectExpr("concat('j', o_orderkey) AS id")).select("id", "status")


@query("b8_progress", f"SELECT id, CASE WHEN k % 3 = 0 THEN 'stage' || (k % 7) ELSE '' END AS stage, CASE WHEN k % 3 = 0 THEN k % 7 / 7e0 ELSE 0e0 END AS pct FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) AS k FROM ({_JOBS}))")
def b8(t: Tables) -> DataFrame:
    """The last of each job's reports."""
    steps = t.read("orders").where("o_orderkey % 3 = 0").selectExpr("concat('j', o_orderkey) AS job_id", "explode(sequence(0, o_orderkey % 7)) AS at", "o_orderkey AS k").selectExpr("job_id", "at", "concat('stage', at) AS stage", "at / 7D AS pct")
    return T.progress(_jobs(t), steps).select("id", "stage", "pct")


@query("h7_newest_jobs", f"SELECT id, dense_rank() OVER (ORDER BY created_at DESC) - 1 AS day FROM ({_JOBS})")
def h7(t: Tables) -> DataFrame:
    """Jobs, newest first: the rank of each one's day in that order."""
    days = T.placed(T.newest(_jobs(t)).select("id", "created_at"))
    first = days.groupBy("created_at").agg(F.min("place").alias("p"))
    rank = T.placed(first.orderBy("p").select("created_at")).withColumnRenamed("place", "day")
    return days.join(rank, "created_at").select("id", "day")


@query("o9_log_segments", sql("""WITH f AS (SELECT DISTINCT det_idx, frame_id FROM det WHERE frame_id % 10 < 4 AND det_idx < 3), r AS (SELECT *, frame_id - row_number() OVER (PARTITION BY det_idx ORDER BY frame_id) AS g FROM f)
SELECT 'det' || det_idx AS source, 'info' AS level, min(frame_id) AS start, max(frame_id) AS "end" FROM r GROUP BY det_idx, g""", "det"))
def o9_segments(t: Tables) -> DataFrame:
    logs = t.det.where("frame_id % 10 < 4 AND det_idx < 3").selectExpr("frame_id", "'info' AS level", "concat('det', det_idx) AS source", "'m' AS message")
    return T.log_segments(logs)


@query("o13_track_vectors", sql("SELECT CAST((frame_id - frame_id % 20) / 20 AS BIGINT) AS video_id, player_id, count(*) AS n, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frames FROM vectors WHERE player_id <> 3 AND vec_id % 5 <> 0 GROUP BY 1, 2", "vectors"))
def o13(t: Tables) -> DataFrame:
    """Each track's vectors in frame order, for videos of twenty frames: untracked rows and null vectors don't count."""
    rows = t.vectors.selectExpr("CAST((frame_id - frame_id % 20) / 20 AS BIGINT) AS video_id", "CASE WHEN player_id = 3 THEN -1 ELSE player_id END AS player_id", "frame_id", "CASE WHEN vec_id % 5 <> 0 THEN embedding END AS vec")
    got = teams.track_vectors(rows, "vec")
    return got.select("video_id", "player_id", F.size("vectors").cast("long").alias("n"), F.array_join("frames", ",").alias("frames"))


@query("o14_sample_teams", sql("""WITH s AS (SELECT video_id * 250 + frame_id AS sample, team_id AS gt, (x1 + det_idx * det_idx) % 2 AS pred, det_idx FROM players WHERE det_idx < 5 OR frame_id % 3 = 0),
e AS (SELECT sample, greatest(sum(CASE WHEN pred = gt THEN 1 ELSE 0 END), sum(CASE WHEN pred = 1 - gt THEN 1 ELSE 0 END)) AS r, count(*) AS n FROM s GROUP BY 1 HAVING count(DISTINCT det_idx) >= 2)
SELECT sample, CAST(r AS BIGINT) AS right_n, n AS total FROM e""", "players"))
def o14(t: Tables) -> DataFrame:
    """Samples of fewer than two tracks are left out."""
    rows = t.players.where("det_idx < 5 OR frame_id % 3 = 0").selectExpr("video_id * 250 + frame_id AS sample", "det_idx AS track_id", "team_id AS gt", "(x1 + det_idx * det_idx) % 2 AS pred")
    return teams.sample_accuracy(rows, "sample").select("sample", F.col("right").alias("right_n"), "total")


@query("o15_numeric_names", "SELECT n_nationkey AS name, CASE WHEN n_nationkey < 5 THEN 0 ELSE 1 END AS team FROM nation")
def o15(t: Tables) -> DataFrame:
    names = t.read("nation").selectExpr("CAST(n_nationkey AS STRING) AS name").unionAll(t.read("nation").selectExpr("n_name AS name"))
    return readers.numeric_names(names, "name").select("name", F.when(F.col("name") < 5, 0).otherwise(1).alias("team"))


@query("o7_stored_homographies", sql("SELECT video_id, frame_id, frame_id % 2 = 0 AS stored, round(CASE WHEN frame_id % 2 = 0 THEN 9e0 ELSE 1e0 END, 3) AS h0 FROM homographies", "homographies"))
def o7(t: Tables) -> DataFrame:
    """A frame's stored homography, else the one its keypoints give."""
    h = _homographies(t)
    slots = court.keypoint_slots(h, "nba")
    pts = court.points_table(t.spark, "nba").select("point", "u", "v")
    points = slots.join(F.broadcast(pts), "point").selectExpr(*FRAME, "px AS sx", "py AS sy", "u AS dx", "v AS dy")
    stored = h.where("frame_id % 2 = 0").select(*FRAME, F.transform("h", lambda x: x * 9).alias("h"))
    got = court.homographies_of(points, stored)
    return got.select(*FRAME, "stored", F.round(F.get("h", F.lit(0)), 3).alias("h0"))


# -- events --------------------------------------------------------------------------------------------------------------------


@query("k_windowed_counts", "SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def k_windows(t: Tables) -> DataFrame:
    """Events by windows of five minutes, as the stream counts them."""
    from ..streaming.online import windowed_counts

    w = windowed_counts(t.read("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("k_sliding_counts", "SELECT w AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([CAST(floor(epoch(ts) / 300) AS BIGINT) * 300, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 - 300]) AS w FROM events) GROUP BY 1, 2")
def k_sliding(t: Tables) -> DataFrame:
    from ..streaming.online import windowed_counts

    w = windowed_counts(t.read("events").withColumn("ts", F.col("ts").cast("timestamp")), window="10 minutes", slide="5 minutes")
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("k_sessions", """WITH x AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM x)
SELECT user_id, min(us) AS start, max(us) + 1800000000 AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def k_sessions(t: Tables) -> DataFrame:
    """Each user's events by sessions that half an hour without events ends."""
    from ..streaming.online import sessions

    s = sessions(t.read("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")
