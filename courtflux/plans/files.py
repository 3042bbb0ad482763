"""Queries of sources and sinks: tables written in a layout, and read back by the scan of that layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..runtime import scratch
from ..sources import corpora, readers, sinks
from .derive import Tables, sql
from .queries import FRAME, HEIGHT, WIDTH, query
from . import timeline as T


def _files(rows: DataFrame, *by: str) -> str:
    """The column ``value`` as text files of a new folder, in folders by the other columns."""
    path = scratch(rows.sparkSession)
    rows.write.partitionBy(*by).text(path)
    return path


def _line(*parts: str | Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))


def _video() -> Column:
    return F.regexp_extract("path", r"video=(\d+)", 1).cast("long").alias("video_id")


def _unit(width: int = WIDTH, height: int = HEIGHT) -> list[Column]:
    """The box as normalised centre and sides, a little to the right of and below its whole pixels, as labels seldom lie on them."""
    x1, y1, x2, y2 = (F.col(c) + 0.3 for c in ("x1", "y1", "x2", "y2"))
    return [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height]


def _lines(rows: DataFrame, value: Column, bad: str, at: Column) -> DataFrame:
    """Rows as lines; beside those where ``at`` holds stands a broken one."""
    return rows.select(F.col("video_id").alias("video"), F.explode(F.when(at, F.array(value, F.lit(bad))).otherwise(F.array(value))).alias("value"))


_BOX = "x1, y1, x2, y2"


@query("a3_yolo_mot", sql(f"SELECT video_id, frame_id, player_id AS id, class_id, {_BOX} FROM players WHERE frame_id % 7 <> 0", "players"))
def a3(t: Tables) -> DataFrame:
    track = F.when(F.col("frame_id") % 7 == 0, -1).otherwise(F.col("player_id"))
    rows = _lines(t.players, _line("frame_id", track, "class_id", *_unit()), "5 1 2 0.5", F.col("frame_id") % 10 == 3)
    got = readers.mot_yolo(t.spark, _files(rows, "video"), WIDTH, HEIGHT)
    return got.select(_video(), "frame_id", "id", "class_id", "x1", "y1", "x2", "y2")


@query("a4_detections_csv", sql(f"SELECT frame_id, class_id, x1 AS bbox_x_min, y1 AS bbox_y_min, x2 AS bbox_x_max, y2 AS bbox_y_max, CASE WHEN det_idx % 3 = 0 THEN NULL ELSE x1 / 4e0 END AS field_x, y1 / 8e0 AS field_y FROM det", "det"))
def a4(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    skip = [F.lit("-").alias(f"skip{i}") for i in range(1, 5)]
    t.det.select("frame_id", "class_id", "x1", "y1", "x2", "y2", *skip, F.when(F.col("det_idx") % 3 != 0, F.col("x1") / 4), F.col("y1") / 8).write.csv(path)
    return readers.mot_csv(t.spark, path).drop("skip1", "skip2", "skip3", "skip4").withColumns({c: F.col(c).cast("long") for c in ("frame_id", "class_id", "bbox_x_min", "bbox_y_min", "bbox_x_max", "bbox_y_max")})


@query("a5_measurements", sql("SELECT video_id, det_idx FROM det WHERE frame_id = 40 AND class_id NOT IN (0, 9)", "det"))
def a5(t: Tables) -> DataFrame:
    kind = F.expr("CASE class_id WHEN 0 THEN 'ball' WHEN 9 THEN 'referee' WHEN 10 THEN NULL ELSE 'player' END")
    return readers.measurements(t.det.withColumn("class", kind), 40).select("video_id", "det_idx")


@query("a6_gt_normalised", sql(f"SELECT video_id, frame_id, player_id AS id, {_BOX} FROM players", "players"))
def a6(t: Tables) -> DataFrame:
    rows = _lines(t.players, _line("frame_id", "player_id", *_unit(), F.lit("1"), F.lit("x"), sep=","), "1,2,oops,0.1,0.1,0.1", F.col("frame_id") % 9 == 4)
    return readers.gt_normalised(t.spark, _files(rows, "video"), WIDTH, HEIGHT).select(_video(), "frame_id", "id", "x1", "y1", "x2", "y2")


def _absolute(t: Tables) -> DataFrame:
    """Corners and sides with fractions, which reading cuts toward zero."""
    x, y = F.col("x1") + 0.25, F.col("y1") + 0.75
    rows = _lines(t.players, _line("frame_id", "player_id", x, y, F.col("x2") - F.col("x1") + 0.5, F.col("y2") - F.col("y1"), sep=","), "1,2,3", F.col("frame_id") % 9 == 4)
    return readers.gt_absolute(t.spark, _files(rows, "video"))


@query("a7_gt_absolute", sql(f"SELECT video_id, frame_id, player_id AS id, {_BOX} FROM players", "players"))
def a7(t: Tables) -> DataFrame:
    return _absolute(t).select(_video(), "frame_id", "id", "x1", "y1", "x2", "y2")


@query("a8_gt_as_detections", sql(f"SELECT video_id, frame_id, player_id AS det_idx, CAST(2 AS BIGINT) AS class_id, 1e0 AS confidence, {_BOX} FROM players", "players"))
def a8(t: Tables) -> DataFrame:
    return readers.as_detections(_absolute(t)).select(_video(), "frame_id", "det_idx", "class_id", "confidence", "x1", "y1", "x2", "y2")


@query("a9_yolo_labels", sql("""SELECT video_id, class_id, greatest(x1 - 300, 0) AS x1, y1, least(x2 - 300, 1920) AS x2, y2 FROM det WHERE class_id BETWEEN 2 AND 8 AND x2 - 300 > 0""", "det"))
def a9(t: Tables) -> DataFrame:
    """Boxes moved over the picture's left edge: cut there, or dropped if they lie beyond it."""
    moved = t.det.withColumn("x1", F.col("x1") - 300).withColumn("x2", F.col("x2") - 300)
    rows = _lines(moved, _line("class_id", *_unit()), "ball 0.1 0.2", F.col("frame_id") % 8 == 0)
    got = readers.yolo_labels(t.spark, _files(rows, "video"), WIDTH, HEIGHT)
    return got.select(_video(), "class_id", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("a10_multishot_labels", sql("SELECT 'video=' || video_id AS sample_id, det_idx AS track_id, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 1920) AS x2, least(y2, 1080) AS y2, CASE WHEN det_idx < 5 THEN 0 ELSE 1 END AS gt FROM det WHERE frame_id % 4 <> 0 AND least(x2, 1920) - greatest(x1, 0) >= 5 AND least(y2, 1080) - greatest(y1, 0) >= 5", "det"))
def a10(t: Tables) -> DataFrame:
    """Lines of every fourth frame have a sixth field and don't count."""
    line = _line("det_idx", *_unit())
    rows = _lines(t.det, F.when(F.col("frame_id") % 4 == 0, F.concat(line, F.lit(" 1"))).otherwise(line), "1 2", F.col("frame_id") % 8 == 1)
    got = readers.multishot_labels(t.spark, _files(rows, "video"), WIDTH, HEIGHT)
    return got.select("sample_id", "track_id", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), "gt")


def _documents(rows: DataFrame, value: Column) -> str:
    """One JSON document a file, in a folder for each video."""
    return _files(rows.select(F.col("video_id").alias("video"), value.alias("value")).repartition("video"), "video")


@query("a11_team_entries", sql("""SELECT 'v' || video_id || '.png' AS image_path, count(*) AS boxes, CAST(sum(x1) AS BIGINT) AS x, string_agg(CAST(team_id AS VARCHAR), '' ORDER BY frame_id, det_idx) AS labels
 FROM players GROUP BY video_id ORDER BY image_path LIMIT 4""", "players"))
def a11(t: Tables) -> DataFrame:
    """The first four entries by image (D20), with all their boxes."""
    some = F.array_sort(F.collect_list(F.struct("frame_id", "det_idx", "x1", "y1", "x2", "y2", "team_id")))
    each = t.players.groupBy("video_id").agg(some.alias("b"))
    entry = F.struct(F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit(".png")).alias("image_path"), F.transform("b", lambda s: F.array(*(s[c] for c in ("x1", "y1", "x2", "y2")))).alias("bboxes"), F.transform("b", lambda s: s["team_id"]).alias("team_labels"))
    got = readers.team_entries(t.spark, _documents(each, F.to_json(F.array(entry))), 4)
    total = F.aggregate("bboxes", F.lit(0).cast("long"), lambda s, x: s + x[0])
    return got.select("image_path", F.size("bboxes").cast("long").alias("boxes"), total.alias("x"), F.array_join("team_labels", "").alias("labels"))


@query("a12_shot_annotations", sql("SELECT 'clip' || video_id || '_' || frame_id AS clip_path, CASE WHEN label = 0 THEN 'invalid' ELSE 'ok' END AS status, frame_id AS start_frame, frame_id + 30 AS finish_frame, CASE WHEN label = 2 THEN frame_id + 9 END AS make_start_frame FROM labels", "labels"))
def a12(t: Tables) -> DataFrame:
    row = F.expr("named_struct('clip_path', concat('clip', video_id, '_', frame_id), 'status', CASE WHEN label = 0 THEN 'invalid' ELSE 'ok' END, 'start_frame', frame_id, 'finish_frame', frame_id + 30, 'make_start_frame', CASE WHEN label = 2 THEN frame_id + 9 END)")
    each = t.labels.groupBy("video_id").agg(F.collect_list(row).alias("annotations"))
    got = readers.shot_annotations(t.spark, _documents(each, F.to_json(F.struct(F.lit("now").alias("updated_at"), "annotations"))))
    return got.select("clip_path", "status", *(F.col(c).cast("long").alias(c) for c in ("start_frame", "finish_frame", "make_start_frame")))


@query("a13_shot_index", sql("""SELECT 'c' || video_id || '_' || frame_id AS clip_path, CASE WHEN frame_id % 3 = 0 THEN '/abs/' || video_id || '_' || frame_id ELSE 'rel/' || video_id || '_' || frame_id END AS sample
 FROM labels WHERE frame_id % 3 = 0 OR frame_id % 5 = 0""", "labels"))
def a13(t: Tables) -> DataFrame:
    name = "concat(video_id, '_', frame_id)"
    path = scratch(t.spark)
    t.labels.selectExpr(f"concat('c', {name}) AS clip_path", f"concat('rel/', {name}) AS sample_path", f"concat('/abs/', {name}) AS sample_path_abs", "'ok' AS status", "frame_id AS start_frame").write.json(path)
    there = t.labels.where("frame_id % 3 = 0").selectExpr(f"concat('/abs/', {name}) AS path").unionAll(t.labels.where("frame_id % 5 = 0").selectExpr(f"concat('rel/', {name}) AS path"))
    return readers.shot_index(t.spark, path, there).select("clip_path", "sample")


@query("a15_court_keypoints", sql("""SELECT 'v' || video_id AS video_file, frame_id AS physical_frame, CAST(33 AS BIGINT) AS points, CASE WHEN k = 0 THEN NULL ELSE k * 0.5e0 END AS x0, CASE WHEN k = 6 THEN NULL ELSE CAST(k AS DOUBLE) END AS h2, k = 6 AS no_h FROM homographies""", "homographies"))
def a15(t: Tables) -> DataFrame:
    """Frames with none to 36 points; a homography of two rows is none."""
    points = F.expr("transform(sequence(1, k * 6), i -> array(k * 0.5D, CAST(i AS DOUBLE)))")
    h = F.expr("CASE WHEN k = 6 THEN array(array(1D, 0D, 0D), array(0D, 1D, 0D)) ELSE array(array(1D, 0D, CAST(k AS DOUBLE)), array(0D, 1D, 0D), array(0D, 0D, 1D)) END")
    frame = F.struct(F.col("frame_id").alias("physical_frame"), F.when(F.col("k") > 0, points).otherwise(F.array()).alias("keypoints_xy"), h.alias("homography"))
    each = t.homographies.groupBy("video_id").agg(F.collect_list(frame).alias("frames"))
    doc = F.to_json(F.struct(F.lit("x").alias("video_path"), F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("video_file"), "frames"))
    got = readers.court_keypoints(t.spark, _documents(each, doc))
    first = F.get(F.get("keypoints_xy", F.lit(0)), F.lit(0))
    return got.select("video_file", F.col("physical_frame").cast("long").alias("physical_frame"), F.size("keypoints_xy").cast("long").alias("points"), first.alias("x0"), F.get("h", F.lit(2)).alias("h2"), F.col("h").isNull().alias("no_h"))


@query("a16_reid_names", sql("SELECT player_id AS pid, video_id AS seq, frame_id AS frame FROM players WHERE frame_id % 5 <> 0", "players"))
def a16(t: Tables) -> DataFrame:
    name = F.expr("concat('/x/', CASE WHEN frame_id % 10 = 0 THEN 'a' ELSE '' END, player_id, '_', video_id, '_', frame_id, CASE WHEN frame_id % 10 = 5 THEN '.jpg' ELSE '.jpeg' END)")
    return readers.reid_names(t.players.select(name.alias("path"))).drop("path")


@query("a17_sequences", "SELECT 's' || n_nationkey AS stem, '/d/s' || n_nationkey || '.mp4' AS video, CASE WHEN n_nationkey % 3 <> 0 THEN '/d/s' || n_nationkey || '_tracking.txt' END AS annotation FROM nation")
def a17(t: Tables) -> DataFrame:
    """Videos with their tracking files, and those that have none."""
    n = t.read("nation")
    files = n.selectExpr("concat('/d/s', n_nationkey, '.mp4') AS path").unionAll(n.where("n_nationkey % 3 <> 0").selectExpr("concat('/d/s', n_nationkey, '_tracking.txt') AS path")).unionAll(n.selectExpr("concat('/d/s', n_nationkey, '.txt') AS path"))
    found, bare = readers.discover(files)
    return found.unionByName(bare, allowMissingColumns=True).select("stem", "video", "annotation")


@query("a18_ocr_labels", """SELECT c_custkey, regexp_replace(regexp_replace(strip_accents(c_name || ' é_' || c_mktsegment), '\\s+', '', 'g'), '[^A-Za-z0-9#]', '', 'g') AS label
 FROM customer WHERE length(regexp_replace(strip_accents(c_name || ' é_' || c_mktsegment), '\\s+', '', 'g')) <= 30""")
def a18(t: Tables) -> DataFrame:
    charset = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789#"
    raw = F.concat("c_name", F.lit(" é_"), "c_mktsegment")
    return t.read("customer").select("c_custkey", X.label(X.ascii_only(raw), charset, 30).alias("label")).where("label is not null")


@query("a19_class_ids", """SELECT CAST(n_regionkey AS BIGINT) AS dataset, n_name AS name, CASE WHEN n_regionkey % 3 = 2 THEN n_nationkey + 5 ELSE row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 END AS id FROM nation""")
def a19(t: Tables) -> DataFrame:
    """Class names of data sets given as a list, as a list in one line, or by id."""
    own = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    names = t.read("nation").select("n_regionkey", "n_nationkey", "n_name", own.alias("k"))
    each = names.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("k", "n_nationkey", "n_name"))).alias("c"))
    block = F.concat(F.lit("names:\n"), F.array_join(F.transform("c", lambda x: F.concat(F.lit("- "), x["n_name"])), "\n"))
    line = F.concat(F.lit("names: ["), F.array_join(F.transform("c", lambda x: F.concat(F.lit("'"), x["n_name"], F.lit("'"))), ", "), F.lit("]"))
    by_id = F.concat(F.lit("names:\n"), F.array_join(F.transform("c", lambda x: F.concat(F.lit("  "), (x["n_nationkey"] + 5).cast("string"), F.lit(": "), x["n_name"])), "\n"))
    kind = F.col("n_regionkey") % 3
    text = F.concat(F.lit("path: /data\ntrain: images\n"), F.when(kind == 0, block).when(kind == 1, line).otherwise(by_id), F.lit("\nnc: 5\n"))
    path = _files(each.select(F.col("n_regionkey").alias("video"), text.alias("value")), "video")
    return readers.class_names(t.spark, path).select(_video().alias("dataset"), "name", "id")


@query("a20_clip_list", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, CASE WHEN s_nationkey = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS place FROM supplier")
def a20(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    t.read("supplier").selectExpr("s_suppkey AS id", "s_name AS title", "nullif(s_nationkey, 0) AS place").write.option("sep", ";").option("header", True).csv(path)
    return readers.clip_list(t.spark, path)


@query("a22_reindexed_labels", """SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_orderkey) - 1 AS new FROM orders WHERE least(20 + o_custkey % 31, 10 + o_orderkey % 45) >= 32""")
def a22(t: Tables) -> DataFrame:
    """Pictures of a least side, numbered anew without gaps."""
    rows = t.read("orders").selectExpr("o_orderkey AS old", "20 + o_custkey % 31 AS width", "10 + o_orderkey % 45 AS height")
    return readers.large_enough(rows, "old", 32).select("old", F.col("index").alias("new"))


#: Four boxes of each frame as the words of a picture.
_WORDS = """SELECT video_id, frame_id, det_idx, x1, y1, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS image,
 row_number() OVER (PARTITION BY video_id, frame_id ORDER BY det_idx) - 1 AS place, {label} AS word FROM {det} WHERE det_idx BETWEEN 4 AND 7"""
_TEXTOCR = "CASE WHEN (frame_id + det_idx) % 6 = 0 THEN '.' ELSE 'w ' || CAST(x1 AS STRING) END"
_COCO = """CASE (frame_id + det_idx) % 8 WHEN 0 THEN '#' WHEN 1 THEN 'a#' WHEN 2 THEN '*' || CAST(x1 AS STRING) WHEN 3 THEN 'A&amp;' || CAST(x1 AS STRING) WHEN 4 THEN '  ' ELSE ' w' || CAST(x1 AS STRING) END"""
_LSVT = """CASE (frame_id + det_idx) % 7 WHEN 0 THEN 'Story #' WHEN 1 THEN 'a#' WHEN 2 THEN 'LOFTINESS*' WHEN 3 THEN 'x中' ELSE 'w' || CAST(x1 AS STRING) END"""
_PAGE = "lpad(CAST(frame_id AS STRING), 4, '0')"


def _words(t: Tables, label: str) -> DataFrame:
    return t.spark.sql(_WORDS.format(label=label, det="{det}"), det=t.det)


def _words_sql(label: str, body: str) -> str:
    return sql(f"WITH words AS ({_WORDS.format(label=label, det='det').replace('STRING', 'VARCHAR')}) {body}", "det")


def _map(key: str, value: str) -> Column:
    """A map in the order of its keys."""
    return F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.expr(key).alias("k"), F.expr(value).alias("v")))))


def _keyed_files(words: DataFrame, image: str, ann: str) -> str:
    """A document a video: images, annotations and each image's list of them, in maps by id."""
    key = f"concat('f', {_PAGE})"
    ids = F.array_sort(F.collect_list(F.concat_ws("_", F.expr(_PAGE), F.col("det_idx").cast("string")))).alias("ids")
    lists = words.groupBy("video_id", "frame_id").agg(ids).groupBy("video_id").agg(_map(key, "ids").alias("imgToAnns"))
    whole = words.groupBy("video_id").agg(_map(key, image).alias("imgs"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", F.expr(_PAGE), F.col("det_idx").cast("string")).alias("k"), F.expr(ann).alias("v")))).alias("anns"))
    return _documents(whole.join(lists, "video_id"), F.to_json(F.struct("imgs", "imgToAnns", "anns")))


def _crops(got: DataFrame, *more: str) -> DataFrame:
    video = F.regexp_extract("document", r"video=(\d+)", 1).cast("long").alias("video_id")
    return got.select(video, F.col("image").cast("long").alias("image"), "label", *more)


_PLACED = ("place", "x1", "y1", "x2", "y2")


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query("a22_textocr", _words_sql(_TEXTOCR, """SELECT video_id, image, place, word AS label, greatest(x1 - 151, 0) AS x1, y1, greatest(x1 - 151, 0) + 61 AS x2, y1 + 21 AS y2,
 CASE det_idx WHEN 4 THEN 0 WHEN 5 THEN 180 WHEN 6 THEN -90 ELSE 90 END AS turn FROM words WHERE word <> '.'"""))
def a22_textocr(t: Tables) -> DataFrame:
    """Level and upright words that begin at each of the four corners."""
    x, y = "x1 - 150.5D", "y1 + 0.25D"
    w, h = "CASE WHEN det_idx < 6 THEN 60D ELSE 20D END", "CASE WHEN det_idx < 6 THEN 20D ELSE 60D END"
    corner = {"tl": f"{x}, {y}", "tr": f"{x} + {w}, {y}", "br": f"{x} + {w}, {y} + {h}", "bl": f"{x}, {y} + {h}"}
    start = {4: ("tl", "tr", "br", "bl"), 5: ("br", "bl", "tl", "tr"), 6: ("bl", "tl", "tr", "br"), 7: ("tr", "br", "bl", "tl")}
    points = " ".join(f"WHEN {k} THEN array({', '.join(corner[c] for c in v)})" for k, v in start.items())
    ann = f"named_struct('utf8_string', word, 'bbox', array({x}, {y}, 60.5D, 20.25D), 'points', CASE det_idx {points} END)"
    got = corpora.textocr(t.spark, _keyed_files(_words(t, _TEXTOCR), f"named_struct('id', concat('f', {_PAGE}), 'file_name', concat(frame_id, '.jpg'))", ann))
    return _longs(_crops(got, *_PLACED, "turn"), *_PLACED, "turn")


@query("a22_coco_text", _words_sql(_COCO, """SELECT video_id, image, place, replace(trim(word), '&amp;', '&') AS label, greatest(x1 - 160, 0) - CASE WHEN x1 > 160 THEN least(2, x1 - 160) ELSE 0 END AS x1, y1 - 2 AS y1,
 least(600, greatest(x1 - 162, 0) + 35) AS x2, y1 + 23 AS y2 FROM words WHERE frame_id % 2 = 0 AND det_idx <> 5 AND frame_id % 7 <> 3 AND (frame_id + det_idx) % 5 <> 0 AND (frame_id + det_idx) % 8 NOT IN (1, 2, 4)"""))
def a22_coco_text(t: Tables) -> DataFrame:
    """One split's legible English print, in pictures 600 pixels wide."""
    image = f"named_struct('id', concat('f', {_PAGE}), 'file_name', concat(frame_id, '.jpg'), 'set', CASE WHEN frame_id % 2 = 0 THEN 'train' ELSE 'val' END, 'width', 600, 'height', 1080)"
    ann = """named_struct('utf8_string', word, 'bbox', array(x1 - 159.5D, y1 + 0.5D, 30.5D, 20.5D), 'class', CASE WHEN det_idx = 5 THEN 'handwritten' ELSE 'machine printed' END,
      'language', CASE WHEN frame_id % 7 = 3 THEN 'not english' ELSE 'english' END, 'legibility', CASE WHEN (frame_id + det_idx) % 5 = 0 THEN 'illegible' ELSE 'legible' END)"""
    return _longs(_crops(corpora.coco_text(t.spark, _keyed_files(_words(t, _COCO), image, ann), "train"), *_PLACED), *_PLACED)


@query("a22_open_images", _words_sql(_TEXTOCR, """SELECT video_id, image, place, word AS label, greatest(x1 - 151, 0) AS x1, y1, greatest(x1 - 151, 0) + 61 AS x2, y1 + 21 AS y2
 FROM words WHERE (frame_id + det_idx) % 5 <> 0 AND frame_id % 7 <> 3"""))
def a22_open_images(t: Tables) -> DataFrame:
    words = _words(t, _TEXTOCR)
    ann = """named_struct('image_id', frame_id + 1000, 'bbox', array(x1 - 150.5D, y1 + 0.25D, 60.5D, 20.25D), 'attributes',
      named_struct('transcription', word, 'legible', (frame_id + det_idx) % 5 <> 0, 'language', CASE WHEN frame_id % 7 = 3 THEN 'other' ELSE 'english' END))"""
    in_order = F.array_sort(F.collect_list(F.struct("frame_id", "det_idx", F.expr(ann).alias("a"))))
    images = F.array_sort(F.collect_set(F.struct((F.col("frame_id") + 1000).alias("id"), F.concat(F.col("frame_id").cast("string"), F.lit(".jpg")).alias("file_name"))))
    each = words.groupBy("video_id").agg(images.alias("images"), in_order.alias("o")).withColumn("annotations", F.transform("o", lambda x: x["a"]))
    got = corpora.open_images(t.spark, _documents(each, F.to_json(F.struct("images", "annotations"))))
    return _longs(_crops(got, *_PLACED), *_PLACED)


@query("a22_lsvt", _words_sql(_LSVT, """SELECT video_id, image, place, word AS label, x1 - 5 AS x1, y1 AS y1, x1 + 60 AS x2, y1 + 27 AS y2
 FROM words WHERE (frame_id + det_idx) % 7 NOT IN (1, 2, 3) AND (frame_id + det_idx) % 5 <> 0"""))
def a22_lsvt(t: Tables) -> DataFrame:
    """Polygons of five points, pictures by name."""
    ann = """named_struct('transcription', word, 'illegibility', (frame_id + det_idx) % 5 = 0,
      'points', array(array(x1, y1), array(x1 + 30, y1 + 3), array(x1 + 60, y1 + 1), array(x1 + 58, y1 + 20), array(x1 - 5, y1 + 27)))"""
    each = _words(t, _LSVT).groupBy("video_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", F.expr(ann).alias("a")))).alias("o")).withColumn("anns", F.transform("o", lambda x: x["a"]))
    doc = each.groupBy("video_id").agg(_map(f"concat('gt_', {_PAGE})", "anns").alias("m"))
    return _longs(_crops(corpora.lsvt(t.spark, _documents(doc, F.to_json("m"))), *_PLACED), *_PLACED)


@query("a22_art", _words_sql(_LSVT, f"""SELECT video_id, image, trim(word) AS label, 'gt_' || {_PAGE.replace('STRING', 'VARCHAR')} || '.jpg' AS file_name FROM words WHERE place = 0 AND frame_id % 3 <> 1 AND (frame_id + det_idx) % 5 <> 0 AND NOT contains(word, '#')"""))
def a22_art(t: Tables) -> DataFrame:
    """Each picture's first word, if in Latin script."""
    ann = "named_struct('transcription', word, 'language', CASE WHEN frame_id % 3 = 1 THEN 'Chinese' ELSE 'Latin' END, 'illegibility', (frame_id + det_idx) % 5 = 0)"
    each = _words(t, _LSVT).groupBy("video_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", F.expr(ann).alias("a")))).alias("o")).withColumn("anns", F.transform("o", lambda x: x["a"]))
    doc = each.groupBy("video_id").agg(_map(f"concat('gt_', {_PAGE})", "anns").alias("m"))
    return _crops(corpora.art(t.spark, _documents(doc, F.to_json("m"))), "file_name")


@query("a22_label_lines", """SELECT 'mlt' AS corpus, c_custkey || '.jpg' AS file_name, c_name || ', ' || c_mktsegment AS label FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey % 5 <> 2
 UNION ALL SELECT 'coco', 'val_words/' || c_custkey || '.jpg', c_name FROM customer WHERE c_custkey % 6 <> 3
 UNION ALL SELECT 'files', 'IMG/' || n_nationkey || '.png', n_name FROM nation""")
def a22_lines(t: Tables) -> DataFrame:
    """Lists of lines, broken ones among them, and a file for each label."""
    c = t.read("customer")
    mlt = scratch(t.spark)
    c.selectExpr("concat(c_custkey, '.jpg,', CASE c_custkey % 4 WHEN 0 THEN 'Latin' WHEN 1 THEN 'Arabic' WHEN 2 THEN 'Symbols' ELSE 'Latin' END, ',', CASE WHEN c_custkey % 5 = 2 THEN '  ' ELSE concat(c_name, ', ', c_mktsegment, ' ') END)").write.text(mlt)
    coco = scratch(t.spark)
    c.selectExpr("CASE WHEN c_custkey % 6 = 3 THEN concat(c_custkey, ' no label') ELSE concat(c_custkey, ', |', c_name, '|') END").write.text(coco)
    own = _files(t.read("nation").selectExpr("n_nationkey AS n", "concat(n_name, '\nmore') AS value"), "n")
    docs = t.spark.read.text(own, wholetext=True, recursiveFileLookup=True).select(F.concat(F.regexp_extract(F.input_file_name(), "n=([0-9]+)", 1), F.lit(".txt")).alias("name"), "value")
    one = corpora.first_lines(docs, "png")
    named = {"mlt": corpora.mlt19(t.spark, mlt), "coco": corpora.coco_words(t.spark, coco, "val"), "files": one}
    parts = [d.select(F.lit(k).alias("corpus"), "file_name", "label") for k, d in named.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("b2_document_lines", sql("SELECT video_id, count(DISTINCT frame_id) AS frames, count(*) AS boxes FROM balls GROUP BY 1", "balls"))
def b2(t: Tables) -> DataFrame:
    """Documents written, a line each without spaces, and read back."""
    each = t.balls.groupBy("video_id").agg(F.collect_list(F.struct("frame_id", "x1")).alias("balls"))
    path = scratch(t.spark)
    sinks.write_documents(each.select(F.to_json(F.struct("video_id", "balls")).alias("document")), path)
    back = t.spark.read.schema("video_id long, balls array<struct<frame_id:long,x1:long>>").json(path)
    return back.select("video_id", F.size(F.array_distinct(F.transform("balls", lambda b: b["frame_id"]))).cast("long").alias("frames"), F.size("balls").cast("long").alias("boxes"))


@query("b3_rounded", sql("SELECT video_id, frame_id, det_idx, round_even(confidence / 7, 4) AS c4, round_even(x1 / 7e0, 2) AS k2, round_even(y1 / 7e0, 1) AS p1, round_even(x2 / 7e0, 3) AS m3 FROM det", "det"))
def b3(t: Tables) -> DataFrame:
    """Confidences to 4 places, key points to 2, polygons to 1, metres to 3."""
    return t.det.select(*FRAME, "det_idx", sinks.rounded(F.col("confidence") / 7).alias("c4"), sinks.rounded(F.col("x1") / 7, sinks.KEYPOINT_PLACES).alias("k2"), sinks.rounded(F.col("y1") / 7, sinks.POLYGON_PLACES).alias("p1"), sinks.rounded(F.col("x2") / 7, sinks.COURT_PLACES).alias("m3"))


@query("b5_training_set", sql(f"""SELECT video_id, frame_id AS start_frame, CASE WHEN label = 2 THEN frame_id ELSE -1 END AS make_start_frame, 'clip' || video_id || '_' || frame_id AS clip_path FROM labels""", "labels"))
def b5(t: Tables) -> DataFrame:
    """Samples as a table and an index of JSON lines; a second part is appended to the first."""
    rows = t.labels.selectExpr("video_id", "concat('clip', video_id, '_', frame_id) AS clip_path", "frame_id AS start_frame", "CASE WHEN label = 2 THEN frame_id END AS make_start_frame")
    path = scratch(t.spark)
    for part in (0, 1):
        sinks.write_training_set(rows.where(F.col("start_frame") % 2 == part), path, ["start_frame", "make_start_frame"])
    index = t.spark.read.schema("clip_path string, video_id long").json(f"{path}/index")
    return t.spark.read.parquet(f"{path}/samples").join(index, ["clip_path", "video_id"]).select("video_id", "start_frame", "make_start_frame", "clip_path")


@query("b6_sorted_annotations", sql("SELECT 'clip' || lpad(CAST(frame_id AS VARCHAR), 6, '0') AS clip_path, count(*) AS n FROM labels GROUP BY 1", "labels"))
def b6(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    sinks.write_annotations(t.labels.groupBy(F.concat(F.lit("clip"), F.lpad(F.col("frame_id").cast("string"), 6, "0")).alias("clip_path")).agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("clip_path string, n long").json(path)


@query("b7_finite_report", sql("SELECT video_id, frame_id, det_idx, CASE WHEN det_idx % 3 = 2 THEN confidence END AS error FROM det", "det"))
def b7(t: Tables) -> DataFrame:
    bad = F.when(F.col("det_idx") % 3 == 0, F.lit(float("nan"))).when(F.col("det_idx") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("confidence"))
    return sinks.finite(t.det.select(*FRAME, "det_idx", bad.alias("error")), ["error"])


@query("o9_frame_log", sql("""SELECT frame_id, '[WARN] [ball] lost ' || det_idx AS line FROM det WHERE video_id = 0 AND class_id = 0 AND frame_id BETWEEN 20 AND 60""", "det"))
def o9(t: Tables) -> DataFrame:
    """Entries appended to a log, and read by frames."""
    path = scratch(t.spark)
    T.log_append(t.det.where("video_id = 0 AND class_id = 0").select("frame_id", F.lit("warn").alias("level"), F.lit("ball").alias("source"), F.concat(F.lit("lost "), F.col("det_idx").cast("string")).alias("message")), path)
    return T.log_entries(T.log_read(t.spark, path), 20, 60)


@query("o10_label_points", sql("SELECT video_id, class_id, CAST(trunc(x1 + 0.3e0) AS BIGINT) AS px, CAST(trunc(y1 + 0.3e0) AS BIGINT) AS py FROM det", "det"))
def o10(t: Tables) -> DataFrame:
    """Lines `cls cx cy` as pixels."""
    rows = _lines(t.det, _line("class_id", (F.col("x1") + 0.3) / WIDTH, (F.col("y1") + 0.3) / HEIGHT), "x 1", F.col("frame_id") % 8 == 1)
    return readers.label_points(t.spark, _files(rows, "video"), WIDTH, HEIGHT).select(_video(), "class_id", "px", "py")


@query("o5_all_stores", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS label FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def o5(t: Tables) -> DataFrame:
    """Label stores of nested folders as one table."""
    path = scratch(t.spark)
    t.read("customer").selectExpr("CAST(c_custkey AS BIGINT) AS id", "c_name AS label").write.json(f"{path}/train/a")
    t.read("supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS id", "s_name AS label").write.json(f"{path}/train/deep/b")
    return readers.all_stores(t.spark, path, "id long, label string")
