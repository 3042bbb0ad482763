"""Scans of annotation and result files, with fixed schemas; broken lines are skipped, not failed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


# -- frame maps ----------------------------------------------------------------------------------------------------------------


def frame_map(meta: DataFrame, target_fps: float = 30.0) -> DataFrame:
    """logical -> physical frames of each video (columns src_fps, src_total): every ratio-th source frame, rounded half-even."""
    fps = F.when(F.col("src_fps") > 0, F.col("src_fps")).otherwise(25.0)
    ratio = fps / F.lit(target_fps)
    total = F.ceil(F.col("src_total") / ratio)
    rows = meta.withColumn("__r", ratio).where("src_total > 0").select("video_id", "src_total", "__r", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("logical"))
    return rows.select("video_id", "logical", F.least(F.bround(F.col("logical") * F.col("__r")).cast("long"), F.col("src_total") - 1).alias("physical"))


def nearest_logical(frames: DataFrame, physical: DataFrame) -> DataFrame:
    """For (video_id, physical) the nearest logical frame, the smaller of two; frames beyond the ends take the end.

    The frame map is sorted, so the last at or before and the first at or after are found by one ordered pass over both.
    """
    from pyspark.sql.window import Window

    asked = physical.select("video_id", F.col("physical").alias("p"), F.lit(None).cast("long").alias("l")).distinct()
    known = frames.groupBy("video_id", F.col("physical").alias("p")).agg(F.min("logical").alias("l"))
    both = known.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True)))
    w = Window.partitionBy("video_id").orderBy("p", "ask")
    hit = F.when(~F.col("ask"), F.struct("p", "l"))
    before = F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(hit, ignorenulls=True).over(Window.partitionBy("video_id").orderBy("p", F.desc("ask")).rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("b", before).withColumn("a", after).where("ask")
    take = F.when(F.col("b").isNull(), F.col("a.l")).when(F.col("a").isNull(), F.col("b.l")).when(F.col("p") - F.col("b.p") <= F.col("a.p") - F.col("p"), F.col("b.l")).otherwise(F.col("a.l"))
    return near.select("video_id", F.col("p").alias("physical"), take.alias("logical"))


def sample_frames(meta: DataFrame, seconds: float) -> DataFrame:
    """Physical frames at every interval."""
    step = F.greatest(F.lit(1), F.bround(F.col("src_fps") * seconds)).cast("long")
    return meta.where("src_total > 0").select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("src_total").cast("long") - 1, step)).alias("physical"))


# -- text tables ---------------------------------------------------------------------------------------------------------------


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("path"))


def fields(df: DataFrame, separator: str, names: list[str], least: int | None = None, exact: bool = False) -> DataFrame:
    """Lines as numbers by name; lines of too few fields or with anything else than numbers are dropped."""
    parts = F.split("value", separator)
    ok = F.size(parts) == len(names) if exact else F.size(parts) >= (least or len(names))
    num = df.where(ok).select("path", *(F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))
    return num.dropna(subset=names)


def corner_box(width: Column | int, height: Column | int) -> list[Column]:
    """x1, y1, x2, y2 in pixels, toward zero, of normalised centre boxes."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    cx, cy, bw, bh = F.col("cx") * w, F.col("cy") * h, F.col("w") * w, F.col("h") * h
    return [x.cast("long").alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (cx - bw / 2, cy - bh / 2, cx + bw / 2, cy + bh / 2))]


def mot_yolo(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """`frame track class cx cy w h` by spaces, normalised; tracks below 0 are dropped."""
    t = fields(lines(spark, path), r"\s+", ["frame", "track", "cls", "cx", "cy", "w", "h"]).where("track >= 0")
    return t.select("path", F.col("frame").cast("long").alias("frame_id"), F.col("track").cast("long").alias("id"), F.col("cls").cast("long").alias("class_id"), *corner_box(width, height))


def mot_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.MOT_CSV).csv(path)


def measurements(df: DataFrame, frame: int) -> DataFrame:
    """Players' rows of a frame; a missing class is a player."""
    kind = F.coalesce("class", F.lit("player")) if "class" in df.columns else F.lit("player")
    return df.where((F.col("frame_id") == frame) & (kind == "player"))


def gt_normalised(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    t = fields(lines(spark, path), ",", ["frame", "obj", "cx", "cy", "w", "h"])
    return t.select("path", F.col("frame").cast("long").alias("frame_id"), F.col("obj").cast("long").alias("id"), *corner_box(width, height))


def gt_absolute(spark: SparkSession, path: str) -> DataFrame:
    t = fields(lines(spark, path), ",", ["frame", "obj", "x", "y", "w", "h"])
    x, y = F.col("x"), F.col("y")
    box = [c.cast("long").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (x, y, x + F.col("w"), y + F.col("h")))]
    return t.select("path", F.col("frame").cast("long").alias("frame_id"), F.col("obj").cast("long").alias("id"), *box)


def as_detections(gt: DataFrame, class_id: int = 2) -> DataFrame:
    """A ground-truth table in the place of a detector's output."""
    return gt.select("path", "frame_id", F.col("id").alias("det_idx"), F.lit(class_id).cast("long").alias("class_id"), F.lit(1.0).alias("confidence"), "x1", "y1", "x2", "y2")


def yolo_labels(spark: SparkSession, path: str, width: int, height: int, low: int = 2, high: int = 8) -> DataFrame:
    """`cls cx cy w h` of a file per image; clipped to it, empty boxes dropped."""
    t = fields(lines(spark, path), r"\s+", ["cls", "cx", "cy", "w", "h"]).where(F.col("cls").between(low, high))
    box = t.select("path", F.col("cls").cast("long").alias("class_id"), *corner_box(width, height))
    clip = box.select("path", "class_id", F.greatest("x1", F.lit(0)).alias("x1"), F.greatest("y1", F.lit(0)).alias("y1"), F.least("x2", F.lit(width)).alias("x2"), F.least("y2", F.lit(height)).alias("y2"))
    return clip.where("x2 > x1 and y2 > y1")


def multishot_labels(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """`track cx cy w h` (exactly five fields) in labels/<sample>/<frame>.txt; boxes under 5 pixels dropped; tracks under 5 are team 0."""
    t = fields(lines(spark, path), r"\s+", ["track", "cx", "cy", "w", "h"], exact=True)
    box = t.select(F.element_at(F.split("path", "/"), -2).alias("sample_id"), F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("frame"), F.col("track").cast("long").alias("track_id"), *corner_box(width, height))
    clip = box.withColumn("x1", F.greatest("x1", F.lit(0))).withColumn("y1", F.greatest("y1", F.lit(0))).withColumn("x2", F.least("x2", F.lit(width))).withColumn("y2", F.least("y2", F.lit(height)))
    return clip.where("x2 - x1 >= 5 and y2 - y1 >= 5").withColumn("gt", F.when(F.col("track_id") < 5, 0).otherwise(1))


def numeric_names(df: DataFrame, column: str) -> DataFrame:
    """Rows whose name is a number, in its order."""
    return df.where(F.col(column).rlike("^[0-9]+$")).withColumn(column, F.col(column).cast("long")).orderBy(column)


def label_points(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Lines `cls cx cy` (normalised) as pixels, toward zero."""
    t = fields(lines(spark, path), r"\s+", ["cls", "cx", "cy"])
    return t.select("path", F.col("cls").cast("long").alias("class_id"), (F.col("cx") * width).cast("long").alias("px"), (F.col("cy") * height).cast("long").alias("py"))


# -- JSON ----------------------------------------------------------------------------------------------------------------------


def team_entries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.schema(S.TEAM_GT).option("multiLine", True).json(path)
    return df.orderBy("image_path").limit(limit) if limit is not None else df


def shot_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SHOT_ANNOTATIONS).option("multiLine", True).json(path).select(F.explode("annotations").alias("a")).select("a.*")


def shot_index(spark: SparkSession, path: str, present: DataFrame) -> DataFrame:
    """Rows of a JSONL index whose sample exists (a listing with column path): the absolute path, else the relative one."""
    rows = spark.read.schema("clip_path string, sample_path string, sample_path_abs string, status string, start_frame int, finish_frame int, shot_start_frame int, shot_end_frame int, make_start_frame int, make_end_frame int").json(path)
    there = present.select(F.col("path").alias("found")).distinct()
    first = rows.join(there, F.col("sample_path_abs") == F.col("found"), "left_semi").withColumn("sample", F.col("sample_path_abs"))
    rest = rows.join(there, F.col("sample_path_abs") == F.col("found"), "left_anti").join(there, F.col("sample_path") == F.col("found"), "left_semi").withColumn("sample", F.col("sample_path"))
    return first.unionByName(rest)


def court_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """A row per annotated frame with 33 keypoints (padded or cut) and a nine-number homography (null if malformed)."""
    raw = spark.read.schema(S.COURT_KEYPOINTS).option("multiLine", True).json(path)
    f = raw.select("video_file", F.explode("frames").alias("f")).select("video_file", "f.*")
    none = F.lit(None).cast("array<double>")
    points = F.slice(F.concat(F.coalesce("keypoints_xy", F.array().cast("array<array<double>>")), F.array_repeat(none, 33)), 1, 33)
    ok = (F.size("homography") == 3) & F.forall("homography", lambda r: F.size(r) == 3)
    return f.withColumn("keypoints_xy", points).withColumn("h", F.when(ok, F.flatten("homography"))).drop("homography")


# -- names ---------------------------------------------------------------------------------------------------------------------


def reid_names(df: DataFrame) -> DataFrame:
    """pid, seq and frame of files named `pid_seq_frame.jpeg`; others are skipped."""
    name, pattern = F.element_at(F.split("path", "/"), -1), r"^(\d+)_(\d+)_(\d+)\.jpeg$"
    return df.where(name.rlike(pattern)).select("path", *(F.regexp_extract(name, pattern, i + 1).cast("long").alias(n) for i, n in enumerate(("pid", "seq", "frame"))))


def discover(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Videos with their tracking files, and videos without one."""
    name = F.element_at(F.split("path", "/"), -1)
    videos = files.where(name.endswith(".mp4")).select(F.regexp_replace(name, r"\.mp4$", "").alias("stem"), F.col("path").alias("video"))
    notes = files.where(name.endswith("_tracking.txt")).select(F.regexp_replace(name, r"_tracking\.txt$", "").alias("stem"), F.col("path").alias("annotation"))
    return videos.join(notes, "stem").orderBy("stem"), videos.join(notes, "stem", "left_anti")


def listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def clip_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).csv(path)


def all_stores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON label stores of all nested folders as one table."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def large_enough(pictures: DataFrame, key: str, least: int) -> DataFrame:
    """Pictures whose sides (width, height) reach ``least``, with a new ``index`` from 0 in the order of a whole-number key.

    Keys are numbered within ranges, and the ranges' counts summed, so that no task sorts all rows.
    """
    from pyspark.sql.window import Window

    kept = pictures.where(F.least("width", "height") >= least).withColumn("__range", F.floor(F.col(key) / 65536))
    sizes = kept.groupBy("__range").agg(F.count("*").alias("__n"))
    base = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return kept.withColumn("__place", place).join(base, "__range").withColumn("index", F.col("__base") + F.col("__place") - 1).drop("__range", "__place", "__base")


def predictions(df: DataFrame, columns: dict[str, str], classes: dict[int, int] | None = None) -> DataFrame:
    """Any model's output as detections: its columns (keys) by our names, boxes as whole pixels toward zero, its class ids by ours (others drop)."""
    named = df.select(*(F.col(own).alias(name) for own, name in columns.items()))
    if classes is not None:
        to = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
        named = named.withColumn("class_id", F.try_element_at(to, F.col("class_id").cast("int")).cast("long")).where("class_id is not null")
    return named.withColumns({c: F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2")})


def keypoint_labels(points: DataFrame, share: float = 0.02, margin: float = 0.0, classes: dict[int, int] | None = None) -> DataFrame:
    """Label rows of projected model points (point, px, py): small boxes inside the picture, the points' ids mapped to a data set's (others drop)."""
    boxes = keypoint_boxes(points, share, margin)
    if classes is None:
        return boxes.withColumn("class_id", F.col("point").cast("long"))
    to = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    return boxes.withColumn("class_id", F.try_element_at(to, F.col("point").cast("int")).cast("long")).where("class_id is not null")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, id) of the data set descriptions below a path: ``names`` as a list of lines, as a list in one line, or as lines by id.

    The entry ends at the next line that begins in the first column without a dash. Quotes around names go; a file without names gives no rows.
    """
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    entry = F.regexp_extract("value", r"(?m)^names:([^\n]*(?:\n(?:[ \t-][^\n]*)?)*)", 1)
    line = F.regexp_extract("e", r"^\s*\[([^\]]*)\]", 1)
    parts = F.when(F.length(line) > 0, F.split(line, ",")).otherwise(F.split("e", "\n"))
    full = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s*-\s*", ""))), lambda x: x != "")
    each = docs.withColumn("e", entry).select("path", F.posexplode(full).alias("at", "item"))
    number = F.regexp_extract("item", r"^(\d+)\s*:\s*(.*)$", 1)
    name = F.when(number != "", F.regexp_extract("item", r"^(\d+)\s*:\s*(.*)$", 2)).otherwise(F.col("item"))
    bare = F.regexp_replace(name, r"""^(['"])(.*)\1$""", "$2")
    return each.select("path", bare.alias("name"), F.when(number != "", number.cast("long")).otherwise(F.col("at").cast("long")).alias("id"))


def keypoint_boxes(frames: DataFrame, share: float = 0.02, margin: float = 0.0) -> DataFrame:
    """Projected model points (px, py in [0, 1]) as small label boxes inside the picture."""
    inside = F.col("px").between(margin, 1 - margin) & F.col("py").between(margin, 1 - margin)
    return frames.where(inside).withColumn("w", F.lit(share)).withColumn("h", F.lit(share))
