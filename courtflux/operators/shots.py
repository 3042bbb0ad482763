"""Shots from frame labels (0 none, 1 shot, 2 make) and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relops import islands, top_k


def shot_events(labels: DataFrame, key: str = "video_id") -> DataFrame:
    """Maximal runs of labels 1 and 2; the make is the longest run of 2 in each, the first of equals."""
    w = Window.partitionBy(key).orderBy("frame_id")
    some = labels.where("label in (1, 2)").withColumn("__before", F.lag("frame_id").over(w)).withColumn("__label", F.lag("label").over(w))
    runs = islands(some, [key], "frame_id", F.col("frame_id") == F.col("__before") + 1, "shot_idx")
    events = runs.groupBy(key, "shot_idx").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"))
    makes = islands(runs, [key, "shot_idx"], "frame_id", F.col("label") == F.col("__label"), "part").where("label = 2")
    each = makes.groupBy(key, "shot_idx", "part").agg(F.min("frame_id").alias("make_start"), F.max("frame_id").alias("make_end"))
    best = top_k(each, [key, "shot_idx"], [F.desc(F.col("make_end") - F.col("make_start")), F.col("make_start")], 1).drop("part")
    return events.join(best, [key, "shot_idx"], "left").withColumn("is_make", F.col("make_start").isNotNull())


def frame_labels(events: DataFrame, meta: DataFrame, key: str = "video_id") -> DataFrame:
    """A label for each frame: a make overrides a shot; ranges are clamped to the video."""
    last = F.col("total_frames").cast("long") - 1
    joined = events.join(meta.select(key, "total_frames"), key)

    def part(a: str, b: str, label: int) -> DataFrame:
        low, high = F.greatest(F.col(a), F.lit(0)), F.least(F.col(b), last)
        return joined.where(F.col(a).isNotNull() & (low <= high)).select(key, F.explode(F.sequence(low, high)).alias("frame_id"), F.lit(label).alias("label"))

    marked = part("start_frame", "end_frame", 1).unionAll(part("make_start", "make_end", 2)).groupBy(key, "frame_id").agg(F.max("label").alias("label"))
    frames = meta.where("total_frames > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("frame_id"))
    return frames.join(marked, [key, "frame_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def from_logits(logits: DataFrame) -> DataFrame:
    """Labels as the first largest of each frame's logits (an array)."""
    from ..functions.vectors import argmax

    return logits.withColumn("label", argmax(F.col("logits")).cast("int"))


def shot_segments(events: DataFrame) -> DataFrame:
    """Events as segments of class shot, and their makes as segments of class make."""
    shots = events.select("video_id", F.lit("shot").alias("cls"), "start_frame", "end_frame")
    return shots.unionAll(events.where("is_make").select("video_id", F.lit("make"), "make_start", "make_end"))


def annotation_faults(a: DataFrame) -> DataFrame:
    """Violated constraints of clip annotations, as an array of names."""

    def bad(low: str, high: str) -> Column:
        return F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) >= F.col(high))

    def outside(low: str, high: str, in_low: str, in_high: str) -> Column:
        return F.col(low).isNotNull() & F.col(in_low).isNotNull() & ((F.col(low) < F.col(in_low)) | (F.col(high) > F.col(in_high)))

    checks = {
        "clip_order": bad("start_frame", "finish_frame"),
        "shot_order": bad("shot_start_frame", "shot_end_frame"),
        "make_order": bad("make_start_frame", "make_end_frame"),
        "shot_outside_clip": outside("shot_start_frame", "shot_end_frame", "start_frame", "finish_frame"),
        "make_outside_shot": outside("make_start_frame", "make_end_frame", "shot_start_frame", "shot_end_frame"),
        "make_without_shot": F.col("make_start_frame").isNotNull() & F.col("shot_start_frame").isNull(),
        "half_open": (F.col("shot_start_frame").isNull() != F.col("shot_end_frame").isNull()) | (F.col("make_start_frame").isNull() != F.col("make_end_frame").isNull()),
    }
    flags = F.array(*(F.when(v, k) for k, v in checks.items()))
    return a.withColumn("faults", F.filter(flags, lambda x: x.isNotNull()))


def clip_range(start: Column, finish: Column, total: Column) -> tuple[Column, Column]:
    """Clip bounds clamped to the video; the whole video if they are missing or empty."""
    last = total - 1
    a, b = F.greatest(F.lit(0), F.least(F.coalesce(start, F.lit(0)), last)), F.greatest(F.lit(0), F.least(F.coalesce(finish, last), last))
    return F.when(a < b, a).otherwise(0), F.when(a < b, b).otherwise(last)


def relative(frame: Column, offset: Column, total: Column) -> Column:
    """A frame counted from a crop's start; null outside [0, total)."""
    r = frame - offset
    return F.when((r >= 0) & (r < total), r)
