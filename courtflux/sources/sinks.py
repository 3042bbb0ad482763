"""Sinks: annotation documents, training rows, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.vectors import cosine_distance
from ..operators.relops import spine

FRAME = ["video_id", "frame_id"]
#: Places that exported numbers are rounded to.
PLACES, KEYPOINT_PLACES, POLYGON_PLACES, COURT_PLACES = 4, 2, 1, 3


def rounded(col: str | Column, places: int = PLACES) -> Column:
    return F.bround(F.col(col) if isinstance(col, str) else col, places)


#: Types of the exported fields, where a table lacks the column.
_FIELDS = {
    "raw_player_id": "int",
    "number": "int",
    "number_confidence": "double",
    "speed": "double",
    "track_number": "int",
    "keypoints": "array<struct<x:double,y:double,c:double>>",
    "polygon": "array<array<double>>",
}


def player_struct(columns: list[str]) -> Column:
    """A player as exported: whole numbers cast, 4 places, key points 2, polygons 1, metres 3; no possession for untracked rows.

    ``columns`` are those that the rows have; of missing ones the fields are null, and raw_player_id is player_id.
    """
    own = {c: F.col(c) if c in columns else F.lit(None).cast(kind) for c, kind in _FIELDS.items()}
    if "raw_player_id" not in columns:
        own["raw_player_id"] = F.col("player_id")
    flat = lambda p: F.array(*(F.bround(p[c], KEYPOINT_PLACES) for c in ("x", "y", "c")))
    return F.struct(
        F.col("player_id").cast("int").alias("player_id"),
        own["raw_player_id"].cast("int").alias("raw_player_id"),
        F.col("team_id").cast("int").alias("team_id"),
        F.array(*(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))).alias("bbox"),
        rounded("confidence").alias("confidence"),
        own["number"].cast("int").alias("jersey_number"),
        rounded(own["number_confidence"]).alias("jersey_confidence"),
        F.when(F.col("court_x").isNotNull(), F.array(rounded("court_x", COURT_PLACES), rounded("court_y", COURT_PLACES))).alias("court_position"),
        rounded(own["speed"]).alias("speed"),
        F.transform(own["keypoints"], flat).alias("skeleton"),
        F.transform(own["polygon"], lambda p: F.transform(p, lambda x: F.bround(x, POLYGON_PLACES))).alias("mask_polygon"),
        F.when(F.col("player_id") == -1, False).otherwise(F.coalesce("is_possession", F.lit(False))).alias("is_possession"),
        own["track_number"].cast("int").alias("track_number"),
    )


def ball_struct() -> Column:
    return F.struct(F.array(*(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))).alias("bbox"), rounded("confidence").alias("confidence"))


def ordered(df: DataFrame, item: Column, name: str) -> DataFrame:
    """A frame's items as an array in det_idx order."""
    got = df.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct(F.col("det_idx").alias("o"), item.alias("v")))).alias("x"))
    return got.select(*FRAME, F.transform("x", lambda s: s["v"]).alias(name))


def cross_frame_matrix(players: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Cosine distances between a frame's players and those of the frame before it, both in player_id order.

    ``frames`` are a video's frames (else those that have players); frames where either has no vector have no row.
    """
    from pyspark.sql.window import Window

    some = players.select(*FRAME).distinct() if frames is None else frames.select(*FRAME)
    frames = some.withColumn("before", F.lag("frame_id").over(Window.partitionBy("video_id").orderBy("frame_id")))
    tracked = players.where("player_id >= 0 and vec is not null").groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("player_id", "vec"))).alias("p"))
    prev = tracked.select("video_id", F.col("frame_id").alias("before"), F.col("p").alias("prev"))
    both = frames.join(tracked, FRAME).join(prev, ["video_id", "before"])
    matrix = F.transform("prev", lambda a: F.transform("p", lambda b: F.bround(cosine_distance(a["vec"], b["vec"]), 4)))
    return both.select(*FRAME, F.transform("prev", lambda x: x["player_id"]).alias("prev_ids"), F.transform("p", lambda x: x["player_id"]).alias("curr_ids"), matrix.alias("matrix"))


def _timed(frame: str | Column, fps: float | Column) -> Column:
    return G.event_time(F.col(frame) if isinstance(frame, str) else frame, fps)


def pass_rows(passes: DataFrame, numbers: DataFrame, fps: float | Column) -> DataFrame:
    """Passes as exported: both players and their numbers, the team, and the time at which the pass ends."""
    a = numbers.select("video_id", F.col("player_id").alias("from_player"), F.col("track_number").alias("from_track_number"))
    b = numbers.select("video_id", F.col("player_id").alias("to_player"), F.col("track_number").alias("to_track_number"))
    both = passes.join(a, ["video_id", "from_player"], "left").join(b, ["video_id", "to_player"], "left")
    return both.select("video_id", "frame_start", "frame_end", F.col("from_player").alias("from_player_id"), F.col("to_player").alias("to_player_id"), "from_track_number", "to_track_number", "team_id", _timed("frame_end", fps).alias("timestamp_sec"))


def shot_rows(shots: DataFrame, numbers: DataFrame, teams: DataFrame, fps: float | Column) -> DataFrame:
    """Shots (with a shooter's player_id, or null) as exported: times, the shooter's number and team; fields of the make only for makes."""
    out = shots.join(numbers, ["video_id", "player_id"], "left").join(teams, ["video_id", "player_id"], "left")
    made = F.col("is_make") & F.col("make_start").isNotNull() & F.col("make_end").isNotNull()
    return out.select(
        "video_id",
        F.col("start_frame").alias("frame_start"),
        F.col("end_frame").alias("frame_end"),
        "is_make",
        _timed("start_frame", fps).alias("timestamp_start_sec"),
        _timed("end_frame", fps).alias("timestamp_end_sec"),
        F.col("player_id").alias("shooter_player_id"),
        F.col("track_number").alias("shooter_track_number"),
        F.col("team_id").alias("shooter_team_id"),
        F.when(made, F.col("make_start")).alias("make_start"),
        F.when(made, F.col("make_end")).alias("make_end"),
        F.when(made, _timed("make_start", fps)).alias("make_timestamp_start_sec"),
        F.when(made, _timed("make_end", fps)).alias("make_timestamp_end_sec"),
    )


PASS_SCHEMA = "video_id long, frame_start long, frame_end long, from_player_id long, to_player_id long, from_track_number long, to_track_number long, team_id long, timestamp_sec double"
SHOT_SCHEMA = "video_id long, frame_start long, frame_end long, is_make boolean, timestamp_start_sec double, timestamp_end_sec double, shooter_player_id long, shooter_track_number long, shooter_team_id long, make_start long, make_end long, make_timestamp_start_sec double, make_timestamp_end_sec double"


def _events(df: DataFrame, name: str) -> DataFrame:
    own = [c for c in df.columns if c != "video_id"]
    return df.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))


def annotation_documents(meta: DataFrame, players: DataFrame, balls: DataFrame, passes: DataFrame | None = None, shots: DataFrame | None = None, step: int = 1) -> DataFrame:
    """video_id and a JSON document: metadata, frames by id in numeric order, and passes and shots as ``pass_rows`` and ``shot_rows`` give them.

    Frames are every ``step``-th of ``total_frames``; where that is null or 0, those that have players or balls. A frame has its players
    and balls in det_idx order and, if the players have vectors (``vec``), their distances to those of the frame before it, else null.
    A video without passes or shots has empty arrays of them. A document holds one video.
    """
    spark = meta.sparkSession
    passes = spark.createDataFrame([], PASS_SCHEMA) if passes is None else passes
    shots = spark.createDataFrame([], SHOT_SCHEMA) if shots is None else shots
    counted = F.coalesce("total_frames", F.lit(0))
    known = spine(meta.where(counted > 0), ["video_id"], "total_frames", step=step)
    seen = players.select(*FRAME).unionAll(balls.select(*FRAME)).distinct().join(meta.where(counted <= 0).select("video_id"), "video_id", "left_semi")
    frames = known.select(*FRAME).unionAll(seen.select(*FRAME))
    each = frames.join(ordered(players, player_struct(players.columns), "players"), FRAME, "left").join(ordered(balls, ball_struct(), "balls"), FRAME, "left")
    if "vec" in players.columns:
        near = cross_frame_matrix(players, frames).select(*FRAME, F.struct(F.col("prev_ids").alias("row_ids"), F.col("curr_ids").alias("col_ids"), F.col("matrix").alias("distances")).alias("near"))
        each = each.join(near, FRAME, "left")
    else:
        each = each.withColumn("near", F.lit(None).cast("struct<row_ids:array<bigint>,col_ids:array<bigint>,distances:array<array<double>>>"))
    frame = F.struct(F.coalesce("players", F.array()).alias("players"), F.coalesce("balls", F.array()).alias("balls"), F.col("near").alias("reid_cross_frame_matrix"))
    in_order = F.array_sort(F.collect_list(F.struct("frame_id", frame.alias("v"))))
    by = each.groupBy("video_id").agg(F.map_from_entries(F.transform(in_order, lambda s: F.struct(s["frame_id"].cast("string").alias("k"), s["v"].alias("v")))).alias("frames"))
    doc = meta.join(by, "video_id", "left").join(_events(passes, "pass_events"), "video_id", "left").join(_events(shots, "shot_events"), "video_id", "left")
    head = F.struct(F.col("fps"), F.col("width"), F.col("height"), F.col("total_frames"), F.lit(step).alias("frame_step"))
    none = F.from_json(F.lit("{}"), "map<string,int>")
    whole = F.struct(head.alias("metadata"), F.col("frames"), F.coalesce("pass_events", F.array()).alias("pass_events"), F.coalesce("shot_events", F.array()).alias("shot_events"))
    bare = F.struct(head.alias("metadata"), none.alias("frames"), F.coalesce("pass_events", F.array()).alias("pass_events"), F.coalesce("shot_events", F.array()).alias("shot_events"))
    keep = {"ignoreNullFields": "false"}
    return doc.select("video_id", F.when(F.col("frames").isNull(), F.to_json(bare, keep)).otherwise(F.to_json(whole, keep)).alias("document"))


def write_documents(docs: DataFrame, path: str) -> None:
    """A compact JSON line for each document."""
    docs.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def training_rows(df: DataFrame, labels: list[str]) -> DataFrame:
    """Null label frames become -1."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in labels})


def write_training_set(df: DataFrame, path: str, labels: list[str]) -> None:
    """Appends samples: their rows as a table, and an index of JSON lines that names them."""
    training_rows(df, labels).write.mode("append").parquet(f"{path}/samples")
    df.select("clip_path", "video_id").write.mode("append").json(f"{path}/index")


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Not finite numbers become null, as reports need."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in columns})


def write_annotations(df: DataFrame, path: str) -> None:
    """Annotations as JSON lines in clip_path order."""
    df.orderBy("clip_path").write.mode("overwrite").json(path)
