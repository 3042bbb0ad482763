"""Queries over the derived tables, each built from the operators, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vectors as V
from ..operators import ball, court, detect, enrich, metrics, possession, shots, smooth, stitch, teams, tracking
from ..operators.relops import asof_backward, band_join, first_seen
from ..sources import readers, sinks
from .derive import Tables, sql

FPS, WIDTH, HEIGHT = 30.0, 1920, 1080
FRAME = ["video_id", "frame_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


#: SQL for the box that possession tests, and for IoU of prefixed boxes.
_M = "greatest(3, CAST(floor(greatest({p}.x2 - {p}.x1, {p}.y2 - {p}.y1) * 0.05e0) AS BIGINT))"
OWN = f"""own AS (SELECT p.*, count(*) OVER (PARTITION BY p.video_id, p.frame_id) AS n FROM players p
  JOIN (SELECT video_id, frame_id, (x1 + x2) * 0.5e0 AS cx, (y1 + y2) * 0.5e0 AS cy FROM balls) b ON p.video_id = b.video_id AND p.frame_id = b.frame_id
  AND b.cx BETWEEN p.x1 - {_M.format(p="p")} AND p.x2 + {_M.format(p="p")} AND b.cy BETWEEN p.y1 - {_M.format(p="p")} AND p.y2 + {_M.format(p="p")})"""


def _inter(a: str, b: str) -> str:
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"


def _area(a: str) -> str:
    return f"(greatest({a}.x2 - {a}.x1, 0) * greatest({a}.y2 - {a}.y1, 0))"


def _iou(a: str, b: str) -> str:
    return f"CAST({_inter(a, b)} AS DOUBLE) / ({_area(a)} + {_area(b)} - {_inter(a, b)})"


def _over(a: str, b: str) -> str:
    return f"CAST({_inter(a, b)} AS DOUBLE) / least({_area(a)}, {_area(b)})"


# -- possession ----------------------------------------------------------------------------------------------------------------


@query("possession_frames", sql(f"WITH {OWN} SELECT video_id, player_id, count(*) AS possession_frames FROM own WHERE n = 1 GROUP BY video_id, player_id", "players", "balls"))
def possession_frames(t: Tables) -> DataFrame:
    """Frames in which the ball is in exactly one player's box, by player: the first real query."""
    rows = possession.frame_owners(t.players.withColumn("is_dribble", F.lit(False)), t.balls)
    return rows.where("is_possession").groupBy("video_id", "player_id").agg(F.count("*").alias("possession_frames"))


@query("e5_frame_owners", sql(f"""WITH {OWN}, one AS (SELECT video_id, frame_id, max(player_id) AS owner FROM own WHERE n = 1 GROUP BY video_id, frame_id)
SELECT p.video_id, p.frame_id, p.player_id, CASE WHEN owner IS NOT NULL THEN p.player_id = owner ELSE p.is_dribble END AS is_possession
FROM players p LEFT JOIN one USING (video_id, frame_id)""", "players", "balls"))
def e5(t: Tables) -> DataFrame:
    return possession.frame_owners(t.players, t.balls).select(*FRAME, "player_id", "is_possession")


@query("e6_hand_owners", sql("""SELECT p.video_id, p.frame_id, p.player_id, round(min(sqrt(pow(h.x - (b.x1 + b.x2) * 0.5e0, 2) + pow(h.y - (b.y1 + b.y2) * 0.5e0, 2))), 6) AS distance
FROM players p JOIN balls b USING (video_id, frame_id), LATERAL (SELECT p.x1 AS x, p.y1 + 70 AS y UNION ALL SELECT p.x2, p.y1 + 70) h
GROUP BY p.video_id, p.frame_id, p.player_id HAVING min(sqrt(pow(h.x - (b.x1 + b.x2) * 0.5e0, 2) + pow(h.y - (b.y1 + b.y2) * 0.5e0, 2))) < 100""", "players", "balls"))
def e6(t: Tables) -> DataFrame:
    hands = t.players.select(*FRAME, "player_id", "det_idx", F.explode(F.array(F.struct(F.col("x1").alias("x"), (F.col("y1") + 70).alias("y")), F.struct(F.col("x2").alias("x"), (F.col("y1") + 70).alias("y")))).alias("h")).select(*FRAME, "player_id", "det_idx", "h.*")
    at = t.balls.select(*FRAME, ((F.col("x1") + F.col("x2")) * 0.5).alias("cx"), ((F.col("y1") + F.col("y2")) * 0.5).alias("cy"))
    return possession.hand_owners(hands, at).withColumn("distance", F.round("distance", 6))


SEGS = f"""{OWN}, held AS (SELECT video_id, frame_id, player_id, row_number() OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS r FROM own WHERE n = 1),
segs AS (SELECT video_id, player_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, row_number() OVER (PARTITION BY video_id ORDER BY min(frame_id)) - 1 AS seg_idx
  FROM held GROUP BY video_id, player_id, frame_id - r)"""


def _segs(t: Tables) -> DataFrame:
    """Runs of frames with one owner."""
    held = possession.frame_owners(t.players.withColumn("is_dribble", F.lit(False)), t.balls).where("is_possession").select(*FRAME, "player_id")
    runs = smooth.islands(held, ["video_id", "player_id"], "frame_id", F.col("frame_id") == smooth.lagged("frame_id", ["video_id", "player_id"], "frame_id") + 1)
    each = runs.groupBy("video_id", "player_id", "island").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame")).drop("island")
    return each.withColumn("seg_idx", F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame")) - 1)


@query("g_owner_runs", sql(f"WITH {SEGS} SELECT * FROM segs", "players", "balls"))
def owner_runs(t: Tables) -> DataFrame:
    return _segs(t)


@query("e7_apply_segments", sql(f"WITH {SEGS} SELECT p.video_id, p.frame_id, p.player_id, bool_or(s.seg_idx IS NOT NULL) AS is_possession FROM players p LEFT JOIN segs s ON s.video_id = p.video_id AND s.player_id = p.player_id AND p.frame_id BETWEEN s.start_frame AND s.end_frame GROUP BY 1, 2, 3", "players", "balls"))
def e7(t: Tables) -> DataFrame:
    return possession.apply_segments(t.players, _segs(t)).select(*FRAME, "player_id", "is_possession")


@query("e8_team_near", sql("""WITH asked AS (SELECT video_id, player_id, frame_id AS at FROM players), known AS (SELECT * FROM players WHERE frame_id % 4 = 1)
SELECT a.video_id, a.player_id, a.at, arg_min(k.frame_id % 2 + 2 * k.team_id + CAST((k.frame_id - k.frame_id % 8) / 8 AS BIGINT) % 5, abs(k.frame_id - a.at) * 2 + CASE WHEN k.frame_id > a.at THEN 1 ELSE 0 END) AS team_id
FROM asked a JOIN known k ON k.video_id = a.video_id AND k.player_id = a.player_id AND k.frame_id BETWEEN a.at - 5 AND a.at + 5 GROUP BY 1, 2, 3""", "players"))
def e8(t: Tables) -> DataFrame:
    asked = t.players.select("video_id", "player_id", F.col("frame_id").alias("at"))
    known = t.players.where("frame_id % 4 = 1").withColumn("team_id", F.expr("frame_id % 2 + 2 * team_id + CAST((frame_id - frame_id % 8) / 8 AS BIGINT) % 5"))
    return possession.team_near(asked, known)


@query("e9_passes", sql(f"""WITH {SEGS}, nx AS (SELECT *, lead(player_id) OVER w AS p2, lead(start_frame) OVER w AS s2 FROM segs WINDOW w AS (PARTITION BY video_id ORDER BY start_frame, end_frame))
SELECT video_id, end_frame AS frame_start, s2 AS frame_end, player_id AS from_player, p2 AS to_player, player_id % 2 AS team_id FROM nx
WHERE p2 <> player_id AND s2 - end_frame - 1 BETWEEN 0 AND 22 AND player_id % 2 = p2 % 2""", "players", "balls"))
def e9(t: Tables) -> DataFrame:
    return possession.passes(_segs(t), t.players, FPS)


@query("g1_possession_segments")
def g1(t: Tables) -> DataFrame:
    return possession.possession_segments(possession.frame_owners(t.players, t.balls), FPS)


@query("g2_possession_strict")
def g2(t: Tables) -> DataFrame:
    return possession.possession_segments(possession.frame_owners(t.players, t.balls), FPS, strict=True)


@query("g3_possession_passes")
def g3(t: Tables) -> DataFrame:
    return possession.possession(t.players, t.balls, FPS)[2]


# -- sources and geometry ------------------------------------------------------------------------------------------------------

_META = "SELECT n_nationkey AS video_id, CAST(20 + n_nationkey % 41 AS DOUBLE) AS src_fps, 90 + n_nationkey * 3 AS src_total FROM nation"
_MAP = f"""meta AS ({_META}), fm AS (SELECT video_id, l AS logical, least(CAST(round_even(l * (src_fps / 30), 0) AS BIGINT), src_total - 1) AS physical
 FROM meta, LATERAL (SELECT unnest(range(0, CAST(ceil(src_total / (src_fps / 30)) AS BIGINT))) AS l))"""


def _meta(t: Tables) -> DataFrame:
    return t.spark.sql(_META.replace("FROM nation", "FROM {nation}"), nation=t.read("nation"))


@query("a1_frame_map", f"WITH {_MAP} SELECT * FROM fm")
def a1(t: Tables) -> DataFrame:
    return readers.frame_map(_meta(t))


@query("a2_nearest_logical", f"WITH {_MAP} SELECT m.video_id, p AS physical, arg_min(f.logical, abs(f.physical - p) * 100000 + f.logical) AS logical FROM meta m, LATERAL (SELECT unnest(range(0, src_total)) AS p) a JOIN fm f ON f.video_id = m.video_id GROUP BY 1, 2")
def a2(t: Tables) -> DataFrame:
    asked = _meta(t).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("src_total").cast("long") - 1)).alias("physical"))
    return readers.nearest_logical(readers.frame_map(_meta(t)), asked)


@query("g21_sample_frames", f"WITH meta AS ({_META}) SELECT video_id, p AS physical FROM meta, LATERAL (SELECT unnest(range(0, src_total, greatest(1, CAST(round_even(src_fps * 0.5e0, 0) AS BIGINT)))) AS p)")
def g21(t: Tables) -> DataFrame:
    return readers.sample_frames(_meta(t), 0.5)


@query("c_box_pairs", sql(f"""SELECT a.video_id, a.frame_id, a.det_idx AS a_idx, b.det_idx AS b_idx, round({_iou('a', 'b')}, 6) AS iou, round({_over('a', 'b')}, 6) AS overlap,
 round(sqrt(pow((a.x1 + a.x2) * 0.5e0 - (b.x1 + b.x2) * 0.5e0, 2) + pow(a.y2 - b.y2, 2)), 6) AS distance, round(CAST(least({_area('a')}, {_area('b')}) AS DOUBLE) / greatest({_area('a')}, {_area('b')}), 6) AS size_ratio,
 (b.x1 >= a.x1 AND b.y1 >= a.y1 AND b.x2 <= a.x2 AND b.y2 <= a.y2) AS inside
FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame_id = b.frame_id AND a.det_idx < b.det_idx""", "det"))
def c_pairs(t: Tables) -> DataFrame:
    pairs = enrich.prefixed(t.det, "a_").join(enrich.prefixed(t.det, "b_"), FRAME).where("a_det_idx < b_det_idx")
    a, b = G.box("a_"), G.box("b_")
    return pairs.select(*FRAME, F.col("a_det_idx").alias("a_idx"), F.col("b_det_idx").alias("b_idx"), F.round(G.iou(a, b), 6).alias("iou"), F.round(G.overlap_ratio(a, b), 6).alias("overlap"), F.round(G.foot_distance(a, b), 6).alias("distance"), F.round(G.size_ratio(a, b), 6).alias("size_ratio"), G.contains(a, b).alias("inside"))


_H = "CAST(k AS DOUBLE) * 0.001e0 - 0.5e0 AS tx, CAST(m AS DOUBLE) * 0.05e0 AS gy"


def _homographies(t: Tables) -> DataFrame:
    h = t.homographies
    return h.select(*FRAME, F.array(F.lit(1.0), F.lit(0.0), F.col("k") * 0.001 - 0.5, F.lit(0.0), F.lit(1.0), F.lit(-0.5), F.lit(0.0), F.col("m") * 0.05, F.lit(1.0)).alias("h"))


_COURT = f"""court AS (SELECT p.*, ((x1 + x2) * 0.5e0 / 1920 + tx) / (gy * (y2 / 1080e0) + 1) * 28.65e0 AS court_x, (y2 / 1080e0 - 0.5e0) / (gy * (y2 / 1080e0) + 1) * 15.24e0 AS court_y
 FROM players p LEFT JOIN (SELECT video_id, frame_id, {_H} FROM homographies) h USING (video_id, frame_id))"""


def _court(t: Tables) -> DataFrame:
    return court.project(t.players, _homographies(t), WIDTH, HEIGHT)


@query("c11_court_positions", sql(f"WITH {_COURT} SELECT video_id, frame_id, det_idx, round(court_x + 1e-9, 6) AS court_x, round(court_y + 1e-9, 6) AS court_y FROM court", "players", "homographies"))
def c11(t: Tables) -> DataFrame:
    return _court(t).select(*FRAME, "det_idx", F.round(F.col("court_x") + 1e-9, 6).alias("court_x"), F.round(F.col("court_y") + 1e-9, 6).alias("court_y"))


# -- filters, top-k, suppression -----------------------------------------------------------------------------------------------


@query("d3_top_players", sql("SELECT video_id, frame_id, det_idx, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY confidence DESC, det_idx) - 1 AS player_id, class_id = 3 AS is_dribble FROM det WHERE class_id BETWEEN 2 AND 8 AND confidence >= 0.1 QUALIFY player_id < 6", "det"))
def d3(t: Tables) -> DataFrame:
    from ..config import Config

    return detect.players(t.det, Config(max_players=6), suppress=False).select(*FRAME, "det_idx", "player_id", "is_dribble")


@query("d2_nms", sql(f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY confidence DESC, det_idx) AS r FROM det),
walk AS (SELECT video_id, frame_id, 0 AS r, [] :: STRUCT(det_idx BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[] AS kept FROM (SELECT DISTINCT video_id, frame_id FROM det)
 UNION ALL SELECT w.video_id, w.frame_id, d.r, CASE WHEN len(list_filter(w.kept, lambda k: {_iou('d', 'k')} >= 0.2 OR {_over('d', 'k')} >= 0.2)) > 0 THEN w.kept
   ELSE list_append(w.kept, {{'det_idx': d.det_idx, 'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2}}) END FROM walk w JOIN ranked d ON d.video_id = w.video_id AND d.frame_id = w.frame_id AND d.r = w.r + 1),
fin AS (SELECT video_id, frame_id, arg_max(kept, r) AS kept FROM walk GROUP BY 1, 2)
SELECT video_id, frame_id, k.det_idx AS det_idx FROM (SELECT video_id, frame_id, unnest(kept) AS k FROM fin)""", "det", recursive=True))
def d2(t: Tables) -> DataFrame:
    return detect.nms(t.det, 0.2).select(*FRAME, "det_idx")


@query("d6_best_of_frame", sql("SELECT video_id, frame_id, arg_max(det_idx, confidence * 1000000 - det_idx) AS det_idx FROM det GROUP BY 1, 2", "det"))
def d6(t: Tables) -> DataFrame:
    return detect.best(t.det).select(*FRAME, "det_idx")


@query("d8_short_tracks", sql("WITH x AS (SELECT video_id, frame_id, det_idx, 100 * det_idx + frame_id % 61 AS player_id FROM players) SELECT video_id, frame_id, det_idx, CASE WHEN count(*) OVER (PARTITION BY video_id, player_id) < 4 THEN -1 ELSE player_id END AS player_id FROM x", "players"))
def d8(t: Tables) -> DataFrame:
    return detect.drop_short_tracks(t.players.withColumn("player_id", F.expr("100 * det_idx + frame_id % 61"))).select(*FRAME, "det_idx", "player_id")


@query("d9_on_court", sql(f"WITH {_COURT} SELECT video_id, frame_id, det_idx FROM (SELECT *, det_idx % 3 = 0 AS m, bool_or(det_idx % 3 = 0 AND frame_id % 2 = 0) OVER (PARTITION BY video_id, frame_id) AS any_m FROM court) WHERE abs(court_x) <= 10 AND abs(court_y) <= 5 AND (NOT any_m OR m)", "players", "homographies"))
def d9(t: Tables) -> DataFrame:
    return detect.on_court(_court(t).withColumn("has_mask", F.expr("det_idx % 3 = 0 AND frame_id % 2 = 0")), 10.0, 5.0).select(*FRAME, "det_idx")


@query("d11_near_edge", sql("SELECT video_id, frame_id, det_idx, x1 <= 5 OR x2 >= max(x2) OVER (PARTITION BY video_id) - 5 AS near_edge FROM det", "det"))
def d11(t: Tables) -> DataFrame:
    return detect.edge_flags(t.det).select(*FRAME, "det_idx", "near_edge")


@query("d14_digits", "SELECT doc_id, CASE WHEN d = '' THEN NULL ELSE CAST(d AS INTEGER) END AS num FROM (SELECT doc_id, substr(regexp_replace(text, '[^0-9]', '', 'g'), 1, 2) AS d FROM documents)")
def d14(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", X.parse_digits(F.col("text")).alias("num"))


@query("d15_number_votes", sql("""WITH v AS (SELECT video_id, frame_id, det_idx % 2 AS box, det_idx % 3 AS num, confidence FROM det WHERE confidence >= 0.5), c AS (SELECT video_id, frame_id, box, num, count(*) AS n, round(avg(confidence), 6) AS confidence FROM v GROUP BY 1, 2, 3, 4)
SELECT video_id, frame_id, box AS det_idx, num, confidence FROM c QUALIFY n * 2 > sum(n) OVER (PARTITION BY video_id, frame_id, box)""", "det"))
def d15(t: Tables) -> DataFrame:
    from ..config import Config

    votes = t.det.select(*FRAME, F.expr("det_idx % 2 AS det_idx"), F.expr("det_idx AS variant"), F.expr("det_idx % 3 AS num"), F.col("confidence").alias("conf"))
    return detect.vote_numbers(votes, Config(ocr_conf=0.5)).withColumn("confidence", F.round("confidence", 6))


# -- joins ---------------------------------------------------------------------------------------------------------------------

_IN = "(i.x1 >= o.x1 AND i.y1 >= o.y1 AND i.x2 <= o.x2 AND i.y2 <= o.y2)"


@query("e1_match_numbers", sql(f"""WITH hits AS (SELECT i.video_id, i.frame_id, i.det_idx AS number_det_idx, o.det_idx, count(*) OVER (PARTITION BY i.video_id, i.frame_id, i.det_idx) AS n FROM numbers i JOIN players o ON i.video_id = o.video_id AND i.frame_id = o.frame_id AND {_IN}
 WHERE NOT EXISTS (SELECT 1 FROM referees o WHERE o.video_id = i.video_id AND o.frame_id = i.frame_id AND {_IN}))
SELECT video_id, frame_id, det_idx, min(number_det_idx) AS number_det_idx FROM hits WHERE n = 1 GROUP BY 1, 2, 3""", "players", "numbers", "referees"))
def e1(t: Tables) -> DataFrame:
    return enrich.match_numbers(t.players, t.numbers, t.referees)


def _poses(t: Tables) -> DataFrame:
    return t.players.selectExpr("video_id", "frame_id", "11 - det_idx AS det_idx", "x1 + 7 * (det_idx % 4) AS x1", "y1 + 3 AS y1", "x2 + 7 * (det_idx % 4) AS x2", "y2 + 3 AS y2")


_POSES = "poses AS (SELECT video_id, frame_id, 11 - det_idx AS det_idx, x1 + 7 * (det_idx % 4) AS x1, y1 + 3 AS y1, x2 + 7 * (det_idx % 4) AS x2, y2 + 3 AS y2 FROM players)"
_PAIRS = f"{_POSES}, pairs AS (SELECT a.video_id, a.frame_id, a.det_idx AS l_det_idx, b.det_idx AS r_det_idx, {_iou('a', 'b')} AS iou FROM players a JOIN poses b USING (video_id, frame_id) WHERE {_iou('a', 'b')} >= 0.3)"


@query("e3_best_poses", sql(f"WITH {_PAIRS} SELECT video_id, frame_id, l_det_idx, r_det_idx, round(iou, 6) AS iou FROM pairs QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, l_det_idx ORDER BY iou DESC, r_det_idx) = 1", "players"))
def e3(t: Tables) -> DataFrame:
    return enrich.match_poses_best(t.players, _poses(t)).withColumn("iou", F.round("iou", 6))


@query("e2_greedy_poses", sql(f"""WITH {_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY iou DESC, l_det_idx, r_det_idx) AS r FROM pairs),
walk AS (SELECT DISTINCT video_id, frame_id, 0 AS r, [] :: STRUCT(l BIGINT, q BIGINT, s DOUBLE)[] AS kept FROM pairs
 UNION ALL SELECT w.video_id, w.frame_id, p.r, CASE WHEN len(list_filter(w.kept, lambda k: k.l = p.l_det_idx OR k.q = p.r_det_idx)) > 0 THEN w.kept ELSE list_append(w.kept, {{'l': p.l_det_idx, 'q': p.r_det_idx, 's': p.iou}}) END FROM walk w JOIN ranked p ON p.video_id = w.video_id AND p.frame_id = w.frame_id AND p.r = w.r + 1),
fin AS (SELECT video_id, frame_id, arg_max(kept, r) AS kept FROM walk GROUP BY 1, 2)
SELECT video_id, frame_id, k.l AS l_det_idx, k.q AS r_det_idx, round(k.s, 6) AS iou FROM (SELECT video_id, frame_id, unnest(kept) AS k FROM fin)""", "players", recursive=True))
def e2(t: Tables) -> DataFrame:
    return enrich.match_poses_greedy(t.players, _poses(t)).withColumn("iou", F.round("iou", 6))


@query("e4_sampled_balls", sql("SELECT video_id, frame_id, det_idx FROM balls WHERE frame_id % 3 = 0", "balls"))
def e4(t: Tables) -> DataFrame:
    return enrich.sampled(t.balls, t.det.where("frame_id % 3 = 0").select(*FRAME).distinct()).select(*FRAME, "det_idx")


@query("e11_first_seen", sql("SELECT video_id, player_id, arg_min(x1 + y1, frame_id * 100 + det_idx) AS v FROM players WHERE frame_id % 5 <> 0 GROUP BY 1, 2", "players"))
def e11(t: Tables) -> DataFrame:
    return first_seen(t.players.withColumn("v", F.expr("CASE WHEN frame_id % 5 <> 0 THEN x1 + y1 END")), ["video_id", "player_id"], "v", ["frame_id", "det_idx"])


_COS = "list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("e12_cross_frame_matrix", sql(f"""SELECT b.frame_id, a.player_id AS prev_id, b.player_id AS curr_id, round({_COS}, 4) AS d FROM vectors a JOIN vectors b ON a.frame_id + 1 = b.frame_id""", "vectors"))
def e12(t: Tables) -> DataFrame:
    m = sinks.cross_frame_matrix(t.vectors.select(F.lit(0).alias("video_id"), "frame_id", "player_id", F.col("embedding").alias("vec")))
    rows = m.select("frame_id", "curr_ids", F.posexplode("matrix").alias("i", "row"), "prev_ids")
    return rows.select("frame_id", F.get("prev_ids", "i").alias("prev_id"), "curr_ids", F.posexplode("row").alias("j", "d")).select("frame_id", "prev_id", F.get("curr_ids", "j").alias("curr_id"), F.round("d", 4).alias("d"))


@query("e13_band_links", sql("SELECT a.video_id, b.frame_id - a.frame_id AS gap, count(*) AS links, CAST(sum(abs(a.x1 - b.x1)) AS BIGINT) AS dx FROM players a JOIN players b ON a.video_id = b.video_id AND b.frame_id - a.frame_id BETWEEN 1 AND 15 GROUP BY 1, 2", "players"))
def e13(t: Tables) -> DataFrame:
    p = t.players
    pairs = band_join(p.select("video_id", "frame_id", "x1"), p.select("video_id", F.col("frame_id").alias("f2"), F.col("x1").alias("x2")), ["video_id"], "frame_id", "f2", 1, 15)
    return pairs.groupBy("video_id", (F.col("f2") - F.col("frame_id")).alias("gap")).agg(F.count("*").alias("links"), F.sum(F.abs(F.col("x1") - F.col("x2"))).alias("dx"))


@query("e20_occluded", sql(f"WITH wide AS (SELECT video_id, frame_id, det_idx, x1, y1, x2 + 150 AS x2, y2 FROM players) SELECT DISTINCT a.video_id, a.frame_id, a.det_idx FROM wide a JOIN wide b ON a.video_id = b.video_id AND a.frame_id = b.frame_id AND a.det_idx <> b.det_idx WHERE {_iou('a', 'b')} > 0.05", "players"))
def e20(t: Tables) -> DataFrame:
    return stitch.occluded(t.players.withColumn("x2", F.col("x2") + 150), stitch.StitchConfig(occluded_iou=0.05))


@query("e22_asof", sql("""WITH a AS (SELECT DISTINCT video_id, frame_id FROM det), k AS (SELECT DISTINCT video_id, frame_id AS key_frame, frame_id * 10 AS v FROM det WHERE frame_id % 10 = 0)
SELECT a.video_id, a.frame_id, max(k.key_frame) AS key_frame, max(k.v) AS v FROM a LEFT JOIN k ON k.video_id = a.video_id AND k.key_frame BETWEEN a.frame_id - 8 AND a.frame_id GROUP BY 1, 2""", "det"))
def e22(t: Tables) -> DataFrame:
    frames = t.det.select(*FRAME).distinct()
    keys = frames.where("frame_id % 10 = 0").select("video_id", F.col("frame_id").alias("key_frame"), (F.col("frame_id") * 10).alias("v"))
    return asof_backward(frames, keys, ["video_id"], "frame_id", "key_frame", "v", 8)


SHOTS = """lab AS (SELECT *, frame_id - row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS g FROM labels WHERE label > 0),
ev AS (SELECT video_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, g FROM lab GROUP BY video_id, g),
mk AS (SELECT video_id, g, min(frame_id) AS make_start, max(frame_id) AS make_end FROM (SELECT *, frame_id - row_number() OVER (PARTITION BY video_id, g ORDER BY frame_id) AS h FROM lab WHERE label = 2) GROUP BY video_id, g, h),
bm AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY video_id, g ORDER BY make_end - make_start DESC, make_start) = 1),
shots AS (SELECT ev.video_id, row_number() OVER (PARTITION BY ev.video_id ORDER BY start_frame) - 1 AS shot_idx, start_frame, end_frame, make_start, make_end, make_start IS NOT NULL AS is_make FROM ev LEFT JOIN bm ON ev.video_id = bm.video_id AND ev.g = bm.g)"""


@query("g4_shot_events", sql(f"WITH {SHOTS} SELECT * FROM shots", "labels"))
def g4(t: Tables) -> DataFrame:
    return shots.shot_events(t.labels)


@query("g5_frame_labels", sql("SELECT video_id, f AS frame_id, coalesce(label, 0) AS label FROM (SELECT video_id, unnest(range(0, count(*))) AS f FROM labels GROUP BY video_id) LEFT JOIN (SELECT video_id, frame_id AS f, label FROM labels WHERE label > 0) USING (video_id, f)", "labels"))
def g5(t: Tables) -> DataFrame:
    """Every run of one label as an event, and back to frame labels."""
    runs = smooth.islands(t.labels.where("label > 0"), ["video_id"], "frame_id", (F.col("frame_id") == smooth.lagged("frame_id", ["video_id"], "frame_id") + 1) & (F.col("label") == smooth.lagged("label", ["video_id"], "frame_id")))
    ev = runs.groupBy("video_id", "island", "label").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b"))
    make = F.col("label") == 2
    events = ev.select("video_id", F.col("a").alias("start_frame"), F.col("b").alias("end_frame"), F.when(make, F.col("a")).alias("make_start"), F.when(make, F.col("b")).alias("make_end"))
    meta = t.labels.groupBy("video_id").agg(F.count("*").alias("total_frames"))
    return shots.frame_labels(events, meta)


@query("e10_shooters", sql(f"""WITH {SHOTS}, seg AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS seg_idx, frame_id AS end_frame, frame_id % 10 AS player_id FROM labels WHERE frame_id % 4 = 1)
SELECT s.video_id, s.shot_idx, arg_min(g.player_id, abs(s.start_frame - g.end_frame) * 100000 + g.seg_idx) AS player_id FROM shots s LEFT JOIN seg g ON g.video_id = s.video_id AND g.end_frame - s.start_frame BETWEEN -15 AND 22 GROUP BY 1, 2""", "labels"))
def e10(t: Tables) -> DataFrame:
    seg = t.labels.where("frame_id % 4 = 1").select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("frame_id")) - 1).alias("seg_idx"), F.col("frame_id").alias("end_frame"), (F.col("frame_id") % 10).alias("player_id"))
    return possession.shooters(shots.shot_events(t.labels), seg, FPS).select("video_id", "shot_idx", "player_id")


# -- aggregates ----------------------------------------------------------------------------------------------------------------


@query("f1_track_numbers", sql("""WITH c AS (SELECT video_id, player_id, (x1 * 7 + y1) % 3 + CASE WHEN frame_id % 3 = 0 THEN 0 ELSE 20 END AS num, frame_id * 100 + det_idx AS o FROM players), n AS (SELECT video_id, player_id, CASE WHEN num >= 20 THEN 20 ELSE num END AS num, o FROM c),
k AS (SELECT video_id, player_id, num, count(*) AS n, min(o) AS o FROM n GROUP BY 1, 2, 3), r AS (SELECT *, sum(n) OVER (PARTITION BY video_id, player_id) AS total, row_number() OVER (PARTITION BY video_id, player_id ORDER BY n DESC, o) AS rk FROM k)
SELECT video_id, player_id, num AS track_number FROM r WHERE rk = 1 AND n * 10 >= total * 6""", "players"))
def f1(t: Tables) -> DataFrame:
    num = F.expr("(x1 * 7 + y1) % 3 + CASE WHEN frame_id % 3 = 0 THEN 0 ELSE 20 END")
    return enrich.track_numbers(t.players.withColumn("num", F.when(num >= 20, 20).otherwise(num)))


@query("f2_tracklet_summaries", sql(f"""WITH {_COURT}, seen AS (SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS up, row_number() OVER (PARTITION BY video_id, player_id ORDER BY frame_id DESC) AS down FROM court WHERE court_x IS NOT NULL),
b AS (SELECT video_id, player_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS frame_count FROM court GROUP BY 1, 2),
e AS (SELECT video_id, player_id, arg_min(court_x, frame_id) AS entry_x, (arg_max(court_x, frame_id) - arg_min(court_x, frame_id)) / (max(frame_id) - min(frame_id)) AS entry_vx FROM seen WHERE up <= 5 GROUP BY 1, 2),
x AS (SELECT video_id, player_id, arg_max(court_x, frame_id) AS exit_x, (arg_max(court_x, frame_id) - arg_min(court_x, frame_id)) / (max(frame_id) - min(frame_id)) AS exit_vx FROM seen WHERE down <= 5 GROUP BY 1, 2)
SELECT b.*, round(entry_x + 1e-9, 6) AS entry_x, round(entry_vx + 1e-9, 6) AS entry_vx, round(exit_x + 1e-9, 6) AS exit_x, round(exit_vx + 1e-9, 6) AS exit_vx FROM b LEFT JOIN e USING (video_id, player_id) LEFT JOIN x USING (video_id, player_id)""", "players", "homographies"))
def f2(t: Tables) -> DataFrame:
    s = stitch.summaries(_court(t).withColumn("num", F.lit(None).cast("long")))
    return s.select("video_id", "player_id", "start_frame", "end_frame", "frame_count", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("entry_x", "entry_vx", "exit_x", "exit_vx")))


@query("f5_pooled_vectors", sql("""WITH m AS (SELECT label, i, median(CAST(embedding[i] AS DOUBLE)) AS m FROM vectors, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT label, i - 1 AS i, round(m / n.n, 6) AS x FROM m JOIN n USING (label)""", "vectors"))
def f5(t: Tables) -> DataFrame:
    p = teams.pooled(t.vectors.select(F.lit(0).alias("v"), F.col("label"), F.col("embedding").alias("color")), "color", ("v", "label"))
    return p.select("label", F.posexplode("pooled").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("f7_gallery_distances", sql(f"SELECT a.label AS a, b.label AS b, round(min({_COS}), 6) AS least FROM vectors a JOIN vectors b ON a.label < b.label GROUP BY 1, 2", "vectors"))
def f7(t: Tables) -> DataFrame:
    return teams.gallery_distances(t.vectors).withColumn("least", F.round("least", 6))


@query("f19_team_accuracy", sql("WITH s AS (SELECT video_id, team_id AS gt, CASE WHEN det_idx % 5 = 0 THEN NULL ELSE (x1 + frame_id) % 2 END AS pred FROM players) SELECT video_id, CAST(greatest(sum(CASE WHEN pred = gt THEN 1 ELSE 0 END), sum(CASE WHEN pred = 1 - gt THEN 1 ELSE 0 END)) AS BIGINT) AS right_n, count(*) AS total FROM s GROUP BY 1", "players"))
def f19(t: Tables) -> DataFrame:
    rows = t.players.selectExpr("video_id", "team_id AS gt", "CASE WHEN det_idx % 5 = 0 THEN NULL ELSE (x1 + frame_id) % 2 END AS pred")
    return teams.split_accuracy(rows, "video_id").select("video_id", F.col("right").alias("right_n"), "total")


@query("f21_reid_scores", sql("""WITH r AS (SELECT q.vec_id AS q, g.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), g.vec_id) AS rk FROM vectors q JOIN vectors g ON q.vec_id % 50 = 0 AND g.vec_id <> q.vec_id),
h AS (SELECT q, rk, row_number() OVER (PARTITION BY q ORDER BY rk) AS n FROM r WHERE hit), e AS (SELECT q, avg(CAST(n AS DOUBLE) / rk) AS ap, min(rk) AS first FROM h GROUP BY 1)
SELECT count(*) AS queries, round(avg(ap), 6) AS map, round(avg(CASE WHEN first <= 1 THEN 1e0 ELSE 0e0 END), 6) AS rank1, round(avg(CASE WHEN first <= 5 THEN 1e0 ELSE 0e0 END), 6) AS rank5, round(avg(CASE WHEN first <= 10 THEN 1e0 ELSE 0e0 END), 6) AS rank10 FROM e""", "vectors"))
def f21(t: Tables) -> DataFrame:
    v = t.vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("pid"), F.col("embedding").alias("v"))
    s = metrics.reid_scores(metrics.reid_ranks(v.where("id % 50 = 0"), v))
    return s.select("queries", *(F.round(c, 6).alias(c) for c in ("map", "rank1", "rank5", "rank10")))


@query("f23_text_scores", """WITH p AS (SELECT c_mktsegment AS dataset, c_name AS gt, substr(c_name, 1, CAST(10 + c_custkey % 9 AS INTEGER)) AS pred, CAST(c_custkey % 100 AS DOUBLE) / 100 AS conf FROM customer)
SELECT dataset, count(*) AS n, round(avg(CASE WHEN gt = pred THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(1 - CAST(levenshtein(pred, gt) AS DOUBLE) / greatest(length(pred), length(gt))), 6) AS ned, round(avg(conf), 6) AS confidence, round(avg(length(pred)), 6) AS length FROM p GROUP BY ROLLUP (dataset)""")
def f23(t: Tables) -> DataFrame:
    rows = t.read("customer").selectExpr("c_mktsegment AS dataset", "c_name AS gt", "substr(c_name, 1, CAST(10 + c_custkey % 9 AS INT)) AS pred", "CAST(c_custkey % 100 AS DOUBLE) / 100 AS conf")
    s = metrics.text_scores(rows)
    return s.select("dataset", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "ned", "confidence", "length")))


# -- sequences -----------------------------------------------------------------------------------------------------------------


@query("g6_chunks", sql("WITH x AS (SELECT video_id, player_id, frame_id, frame_id - lag(frame_id) OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS d FROM players WHERE (frame_id + player_id * 7) % 60 < 25) SELECT video_id, player_id, frame_id, CAST(sum(CASE WHEN d <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, player_id ORDER BY frame_id) AS BIGINT) - 1 AS chunk FROM x", "players"))
def g6(t: Tables) -> DataFrame:
    return smooth.chunks(t.players.where("(frame_id + player_id * 7) % 60 < 25")).select("video_id", "player_id", "frame_id", "chunk")


@query("g7_clean_outliers", sql(f"""WITH {_COURT}, m AS (SELECT *, abs(y2 - median(y2) OVER (PARTITION BY video_id, player_id ORDER BY frame_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) > 30 AS far FROM court)
SELECT video_id, player_id, frame_id, CASE WHEN far THEN NULL ELSE round(court_x + 1e-9, 6) END AS court_x FROM m""", "players", "homographies"))
def g7(t: Tables) -> DataFrame:
    return smooth.clean_outliers(_court(t)).select("video_id", "player_id", "frame_id", F.round(F.col("court_x") + 1e-9, 6).alias("court_x"))


@query("g12_interpolated_balls", sql("""WITH b AS (SELECT * FROM balls WHERE frame_id % 5 IN (0, 1) AND frame_id % 70 < 66), n AS (SELECT *, lead(frame_id) OVER w AS f2, lead(x1) OVER w AS a, lead(y1) OVER w AS b, lead(x2) OVER w AS c, lead(y2) OVER w AS d FROM b WINDOW w AS (PARTITION BY video_id ORDER BY frame_id))
SELECT video_id, frame_id, confidence, x1, y1, x2, y2 FROM b UNION ALL
SELECT video_id, frame_id + k, 0e0, CAST(round_even(x1 + (a - x1) * (k / CAST(f2 - frame_id AS DOUBLE)), 0) AS BIGINT), CAST(round_even(y1 + (b - y1) * (k / CAST(f2 - frame_id AS DOUBLE)), 0) AS BIGINT),
 CAST(round_even(x2 + (c - x2) * (k / CAST(f2 - frame_id AS DOUBLE)), 0) AS BIGINT), CAST(round_even(y2 + (d - y2) * (k / CAST(f2 - frame_id AS DOUBLE)), 0) AS BIGINT) FROM n, LATERAL (SELECT unnest(range(1, f2 - frame_id)) AS k) WHERE f2 - frame_id - 1 BETWEEN 1 AND 50""", "balls"))
def g12(t: Tables) -> DataFrame:
    return ball.interpolate(t.balls.where("frame_id % 5 IN (0, 1) AND frame_id % 70 < 66"))


@query("g14_trails", sql("SELECT video_id, player_id, frame_id, count(*) OVER w AS n, CAST(sum(x1) OVER w AS BIGINT) AS s FROM players WINDOW w AS (PARTITION BY video_id, player_id ORDER BY frame_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", "players"))
def g14(t: Tables) -> DataFrame:
    tr = smooth.trails(t.players.selectExpr("video_id", "player_id", "frame_id", "x1 AS court_x", "y1 AS court_y"))
    return tr.select("video_id", "player_id", "frame_id", F.size("trail").cast("long").alias("n"), F.aggregate("trail", F.lit(0).cast("long"), lambda s, x: s + x["court_x"]).alias("s"))


@query("g17_fill_both_ways", sql("""WITH f AS (SELECT DISTINCT video_id, frame_id, CASE WHEN frame_id % 9 BETWEEN 4 AND 6 THEN frame_id END AS v FROM det)
SELECT video_id, frame_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_id), first_value(v IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM f""", "det"))
def g17(t: Tables) -> DataFrame:
    return smooth.fill_both_ways(t.det.selectExpr("video_id", "frame_id", "CASE WHEN frame_id % 9 BETWEEN 4 AND 6 THEN frame_id END AS v").distinct(), "v")


@query("g22_track_segments", sql("SELECT video_id, player_id, frame_id, CAST(floor((frame_id - min(frame_id) OVER (PARTITION BY video_id, player_id)) / 40e0) AS BIGINT) AS segment FROM players", "players"))
def g22(t: Tables) -> DataFrame:
    return smooth.track_segments(t.players, 40).select("video_id", "player_id", "frame_id", "segment")


@query("h2_timeline", sql(f"""WITH {SHOTS}, u AS (SELECT video_id, start_frame AS frame, 2 AS o, 'shot' AS kind FROM shots UNION ALL SELECT video_id, frame_id, 1, 'pass' FROM labels WHERE frame_id % 11 = 0 UNION ALL SELECT video_id, frame_id, 0, 'comment' FROM labels WHERE frame_id % 13 = 0)
SELECT video_id, frame, kind, row_number() OVER (PARTITION BY video_id ORDER BY frame, o) AS pos FROM u""", "labels"))
def h2(t: Tables) -> DataFrame:
    from .timeline import timeline

    lab = t.labels
    return timeline(lab.where("frame_id % 11 = 0").select("video_id", F.col("frame_id").alias("frame")), shots.shot_events(lab).select("video_id", F.col("start_frame").alias("frame")), lab.where("frame_id % 13 = 0").select("video_id", F.col("frame_id").alias("frame")))


@query("b1_annotations")
def b1(t: Tables) -> DataFrame:
    rows, segs, passes = possession.possession(_court(t), t.balls, FPS)
    meta = t.det.groupBy("video_id").agg((F.max("frame_id") + 1).alias("total_frames")).select("video_id", F.lit(FPS).alias("fps"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "total_frames")
    shot = possession.shooters(segs.select("video_id", F.col("seg_idx").alias("shot_idx"), "start_frame", "end_frame"), segs, FPS)
    none = F.lit(None).cast("long")
    numbers = rows.where("player_id >= 0").select("video_id", "player_id", (F.col("player_id") + 10).alias("track_number")).distinct()
    mates = enrich.look_up(rows.where("player_id >= 0"), "team_id")
    return sinks.annotation_documents(meta, rows.withColumn("track_number", F.col("player_id") + 10), t.balls, sinks.pass_rows(passes, numbers, FPS), sinks.shot_rows(shot.withColumn("is_make", F.lit(False)).withColumn("make_start", none).withColumn("make_end", none), numbers, mates, FPS), step=5)


# -- identities ----------------------------------------------------------------------------------------------------------------


def _few(t: Tables) -> DataFrame:
    return _court(t).drop("player_id", "team_id", "is_dribble")


@query("i2_flow_tracks")
def i2(t: Tables) -> DataFrame:
    return tracking.track_flow(t.players.drop("player_id"), FPS, tracking.FlowConfig(tracks=8)).select(*FRAME, "det_idx", "player_id")


@query("i6_court_tracks")
def i6(t: Tables) -> DataFrame:
    return tracking.track_court(_few(t)).select(*FRAME, "det_idx", "player_id")


@query("i9_appearance_tracks")
def i9(t: Tables) -> DataFrame:
    return tracking.track_appearance(t.players).select(*FRAME, "det_idx", "player_id")


@query("i11_stitched")
def i11(t: Tables) -> DataFrame:
    return stitch.stitch(tracking.track_court(_few(t)), FPS).select(*FRAME, "det_idx", "player_id", "raw_player_id")


@query("i13_team_ids")
def i13(t: Tables) -> DataFrame:
    v = t.vectors.select(F.expr("CAST((frame_id - frame_id % 20) / 20 AS BIGINT) AS video_id"), "player_id", F.col("embedding").alias("color"))
    return teams.team_ids(v)





# -- timelines, counts, further metrics ----------------------------------------------------------------------------------------


@query("f8_class_accuracy", sql("SELECT label, grouping(label) = 1 AS overall, count(*) AS n, round(avg(CASE WHEN label = pred THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM (SELECT label, CASE WHEN frame_id % 4 = 0 THEN 0 ELSE label END AS pred FROM labels) GROUP BY ROLLUP (label)", "labels"))
def f8(t: Tables) -> DataFrame:
    rows = t.labels.selectExpr("label", "CASE WHEN frame_id % 4 = 0 THEN 0 ELSE label END AS pred")
    return metrics.class_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


@query("f20_team_summary", sql("""WITH s AS (SELECT video_id * 8 + frame_id % 8 AS sample, team_id AS gt, (x1 + det_idx * det_idx) % 2 AS pred FROM players),
e AS (SELECT sample, greatest(sum(CASE WHEN pred = gt THEN 1 ELSE 0 END), sum(CASE WHEN pred = 1 - gt THEN 1 ELSE 0 END)) AS r, count(*) AS n FROM s GROUP BY 1)
SELECT round(sum(r) / CAST(sum(n) AS DOUBLE), 6) AS micro, round(avg(r / CAST(n AS DOUBLE)), 6) AS mean, round(median(r / CAST(n AS DOUBLE)), 6) AS median, count(*) AS samples FROM e""", "players"))
def f20(t: Tables) -> DataFrame:
    rows = t.players.selectExpr("video_id * 8 + frame_id % 8 AS sample", "team_id AS gt", "(x1 + det_idx * det_idx) % 2 AS pred")
    s = teams.split_summary(teams.split_accuracy(rows, "sample"))
    return s.select(*(F.round(c, 6).alias(c) for c in ("micro", "mean", "median")), "samples")


@query("f25_weighted_histogram", sql("""WITH w AS (SELECT video_id, least(CAST(floor(y1 * 8 / 1080e0) AS BIGINT), 7) AS bin, sum(confidence) AS w FROM det GROUP BY 1, 2)
SELECT video_id, bin, round(w, 6) AS w, round(w / sum(w) OVER (PARTITION BY video_id), 6) AS share FROM w""", "det"))
def f25(t: Tables) -> DataFrame:
    h = teams.weighted_histogram(t.det, ["video_id"], "y1", "confidence", 8, 1080.0)
    return h.select("video_id", "bin", F.round("w", 6).alias("w"), F.round("share", 6).alias("share"))


@query("f26_event_counts", sql(f"""WITH {SHOTS}, p AS (SELECT video_id, count(*) AS passes FROM labels WHERE frame_id % 11 = 0 GROUP BY 1), s AS (SELECT video_id, count(*) AS shots FROM shots GROUP BY 1), c AS (SELECT video_id, count(*) AS comments FROM labels WHERE frame_id % 13 = 5 GROUP BY 1)
SELECT video_id, coalesce(passes, 0) AS passes, coalesce(shots, 0) AS shots, coalesce(comments, 0) AS comments FROM p FULL JOIN s USING (video_id) FULL JOIN c USING (video_id)""", "labels"))
def f26(t: Tables) -> DataFrame:
    from .timeline import counts

    lab = t.labels
    return counts(lab.where("frame_id % 11 = 0"), shots.shot_events(lab), lab.where("frame_id % 13 = 5"))


@query("f27_frame_step", sql("SELECT video_id, 3 + video_id % 4 AS step FROM det WHERE frame_id % (3 + video_id % 4) = 0 GROUP BY video_id HAVING count(DISTINCT frame_id) > 1", "det"))
def f27(t: Tables) -> DataFrame:
    from .timeline import frame_step

    return frame_step(t.det.where("frame_id % (3 + video_id % 4) = 0").select(*FRAME).distinct())


@query("e24_overlay", sql("""WITH f AS (SELECT DISTINCT video_id, frame_id FROM det WHERE frame_id % 10 = 0), e AS (SELECT DISTINCT video_id, frame_id - 5 AS start, frame_id AS "end" FROM det WHERE frame_id % 7 = 3)
SELECT f.video_id, f.frame_id, e.start, e."end" FROM f JOIN e ON f.video_id = e.video_id AND f.frame_id BETWEEN e."end" - 12 AND e."end" + 55 QUALIFY row_number() OVER (PARTITION BY f.video_id, f.frame_id ORDER BY e."end" DESC, e.start DESC) <= 6""", "det"))
def e24(t: Tables) -> DataFrame:
    from .timeline import overlay

    frames = t.det.select(*FRAME).distinct()
    return overlay(frames.where("frame_id % 7 = 3").selectExpr("video_id", "frame_id - 5 AS start", "frame_id AS end"), frames.where("frame_id % 10 = 0"))


@query("o8_viewer_counts", sql("""WITH p AS (SELECT video_id, frame_id, count(*) AS n FROM players GROUP BY 1, 2), b AS (SELECT video_id, frame_id, count(*) AS n FROM balls GROUP BY 1, 2), m AS (SELECT video_id, max(frame_id) + 1 AS total_frames FROM det GROUP BY 1)
SELECT m.video_id, (SELECT max(n) FROM p WHERE p.video_id = m.video_id) AS max_players, (SELECT max(n) FROM b WHERE b.video_id = m.video_id) AS max_balls, round((SELECT sum(n) FROM p WHERE p.video_id = m.video_id) / CAST(total_frames AS DOUBLE), 6) AS mean_players FROM m""", "players", "balls"))
def o8(t: Tables) -> DataFrame:
    from .timeline import viewer_counts

    meta = t.det.groupBy("video_id").agg((F.max("frame_id") + 1).alias("total_frames"))
    return viewer_counts(t.players, t.balls, meta).withColumn("mean_players", F.round("mean_players", 6))


@query("o2_ball_handler", sql("""WITH h AS (SELECT p.video_id, p.frame_id, p.det_idx, h.x, h.y FROM players p, LATERAL (SELECT p.x1 AS x, p.y1 + 70 AS y UNION ALL SELECT p.x2, p.y1 + 70) h), b AS (SELECT video_id, frame_id, (x1 + x2) * 0.5e0 AS bx, (y1 + y2) * 0.5e0 AS bd FROM balls),
d AS (SELECT h.*, sqrt(pow(x - bx, 2) + pow(y - bd, 2)) AS distance FROM h JOIN b USING (video_id, frame_id))
SELECT video_id, frame_id, det_idx, round(min(distance), 6) AS distance FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY video_id, frame_id ORDER BY distance, det_idx) = 1) WHERE distance <= 30 GROUP BY 1, 2, 3""", "players", "balls"))
def o2(t: Tables) -> DataFrame:
    hands = t.players.select(*FRAME, "det_idx", F.explode(F.array(F.struct(F.col("x1").alias("x"), (F.col("y1") + 70).alias("y")), F.struct(F.col("x2").alias("x"), (F.col("y1") + 70).alias("y")))).alias("h")).select(*FRAME, "det_idx", "h.*")
    at = t.balls.select(*FRAME, ((F.col("x1") + F.col("x2")) * 0.5).alias("cx"), ((F.col("y1") + F.col("y2")) * 0.5).alias("cy"))
    return enrich.nearest_hand(hands, at).select(*FRAME, "det_idx", F.round("distance", 6).alias("distance"))


@query("c13_rims", sql("""WITH r AS (SELECT *, CASE WHEN CASE WHEN det_idx % 2 = 0 THEN CAST(x1 AS DOUBLE) - 900 END < 0 THEN 'left' WHEN det_idx % 2 = 0 THEN 'right' WHEN x1 / 1920e0 < 0.5 THEN 'left' ELSE 'right' END AS side FROM det)
SELECT video_id, frame_id, side, det_idx FROM r QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, side ORDER BY confidence DESC, det_idx) = 1""", "det"))
def c13(t: Tables) -> DataFrame:
    rows = t.det.withColumn("court_x", F.expr("CASE WHEN det_idx % 2 = 0 THEN CAST(x1 AS DOUBLE) - 900 END")).withColumn("x_rel", F.col("x1") / WIDTH)
    return detect.left_right_rims(rows).select(*FRAME, "side", "det_idx")


@query("h3_game_events", sql(f"""WITH {SHOTS}, u AS (SELECT video_id, start_frame AS s, end_frame AS e, 'shot' AS kind FROM shots UNION ALL SELECT video_id, frame_id, frame_id + 4, 'pass' FROM labels WHERE frame_id % 9 = 2)
SELECT video_id, s AS start, e AS "end", kind FROM u""", "labels"))
def h3(t: Tables) -> DataFrame:
    from .timeline import game_events

    lab = t.labels
    return game_events(lab.where("frame_id % 9 = 2").selectExpr("video_id", "frame_id AS start", "frame_id + 4 AS end"), shots.shot_events(lab).selectExpr("video_id", "start_frame AS start", "end_frame AS end"))


@query("h8_current_owner", sql("SELECT video_id, frame_id, arg_min(player_id, det_idx) AS player_id FROM players WHERE is_dribble GROUP BY 1, 2", "players"))
def h8(t: Tables) -> DataFrame:
    from .timeline import owner

    return owner(t.players.withColumn("is_possession", F.col("is_dribble")))


@query("o6_unfinished", sql("SELECT DISTINCT video_id FROM det WHERE frame_id % 20 = 0 AND (video_id, frame_id) NOT IN (SELECT video_id, frame_id FROM det WHERE (frame_id + video_id) % 40 < 20 OR video_id % 2 = 0)", "det"))
def o6(t: Tables) -> DataFrame:
    from .timeline import unfinished

    frames = t.det.select("video_id", F.col("frame_id").alias("physical")).distinct()
    return unfinished(frames.select("video_id").distinct(), frames.where("physical % 20 = 0"), frames.where("(physical + video_id) % 40 < 20 OR video_id % 2 = 0"))


@query("d17_annotation_faults", sql("""WITH a AS (SELECT video_id, frame_id AS shot_start_frame, frame_id + det_idx - 4 AS shot_end_frame, det_idx FROM det)
SELECT video_id, shot_start_frame, det_idx, shot_start_frame >= shot_end_frame AS bad_order, shot_start_frame < 10 OR shot_end_frame > 200 AS outside FROM a""", "det"))
def d17(t: Tables) -> DataFrame:
    none = F.lit(None).cast("long")
    a = t.det.select("video_id", "det_idx", F.col("frame_id").alias("shot_start_frame"), (F.col("frame_id") + F.col("det_idx") - 4).alias("shot_end_frame"), F.lit(10).alias("start_frame"), F.lit(200).alias("finish_frame"), none.alias("make_start_frame"), none.alias("make_end_frame"))
    f = shots.annotation_faults(a)
    return f.select("video_id", "shot_start_frame", "det_idx", F.array_contains("faults", "shot_order").alias("bad_order"), F.array_contains("faults", "shot_outside_clip").alias("outside"))


from . import extra, files  # noqa: E402, F401  (they add theirs)
