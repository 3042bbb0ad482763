"""What the viewer lists: timelines, active events, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import scratch


def timeline(passes: DataFrame, shots: DataFrame, comments: DataFrame) -> DataFrame:
    """Events (video_id, frame) by frame, then comments before passes before shots, with their place."""
    parts = [d.select("video_id", "frame", F.lit(o).alias("o"), F.lit(k).alias("kind")) for d, o, k in ((comments, 0, "comment"), (passes, 1, "pass"), (shots, 2, "shot"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("video_id").orderBy("frame", "o"))).drop("o")


def game_events(passes: DataFrame, shots: DataFrame) -> DataFrame:
    """Events with start and end, by start, then end, then passes first."""
    rows = passes.select("video_id", "start", "end", F.lit("pass").alias("kind")).unionByName(shots.select("video_id", "start", "end", F.lit("shot").alias("kind")))
    return rows.orderBy("video_id", "start", "end", F.col("kind") != "pass")


def placed(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with their ``place`` from 0: counts of the partitions before, and places within them."""
    spark = ordered.sparkSession
    kept = scratch(spark)
    ordered.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()).write.parquet(kept)
    rows = spark.read.parquet(kept)
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    base = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(base), "__p").withColumn("place", F.col("__base") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__n", "__first", "__base")


def all_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two tables' frames, with ``in_a`` and ``in_b``."""
    parts = [d.select("video_id", "frame_id", F.lit(x).alias("in_a"), F.lit(not x).alias("in_b")) for d, x in ((a, True), (b, False))]
    return parts[0].unionByName(parts[1]).groupBy("video_id", "frame_id").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))


def comment_frames(comments: DataFrame, fps: float) -> DataFrame:
    """Comments at frames, half up as the viewer rounds."""
    return comments.withColumn("frame", F.floor(F.col("timestamp_sec") * fps + 0.5))


def active(events: DataFrame, frame: int) -> DataFrame:
    """The first event that contains a frame."""
    return events.where((F.col("start") <= frame) & (F.col("end") >= frame)).orderBy("start", "end").limit(1)


def overlay(events: DataFrame, frames: DataFrame, before: int = 12, after: int = 55, most: int = 6) -> DataFrame:
    """For each frame its latest events whose window [end - before, end + after] holds it."""
    from ..operators.relops import band_join, top_k

    near = band_join(frames.select("video_id", "frame_id"), events, ["video_id"], "frame_id", "end", -after, before)
    return top_k(near, ["video_id", "frame_id"], [F.desc("end"), F.desc("start")], most)


def owner(rows: DataFrame) -> DataFrame:
    """A frame's first player with the ball."""
    return rows.where("is_possession").groupBy("video_id", "frame_id").agg(F.min_by("player_id", "det_idx").alias("player_id"))


def counts(passes: DataFrame, shots: DataFrame, comments: DataFrame) -> DataFrame:
    each = [d.groupBy("video_id").agg(F.count("*").alias(n)) for d, n in ((passes, "passes"), (shots, "shots"), (comments, "comments"))]
    return each[0].join(each[1], "video_id", "full_outer").join(each[2], "video_id", "full_outer").na.fill(0)


def frame_step(frames: DataFrame) -> DataFrame:
    """The greatest common divisor of a video's frame distances."""
    d = frames.withColumn("d", F.col("frame_id") - F.lag("frame_id").over(Window.partitionBy("video_id").orderBy("frame_id"))).where("d > 0").groupBy("video_id").agg(F.collect_set("d").alias("ds"))

    def gcd(a, b):
        # Euclid's steps on a pair, as many as 64-bit numbers can need.
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
        return pair["a"]

    return d.select("video_id", F.aggregate("ds", F.lit(0).cast("long"), gcd).alias("step"))


def viewer_counts(rows: DataFrame, balls: DataFrame, meta: DataFrame) -> DataFrame:
    """Largest numbers of players and balls in a frame, and mean players over all frames, empty ones included."""
    p = rows.groupBy("video_id", "frame_id").count().groupBy("video_id").agg(F.max("count").alias("max_players"), F.sum("count").alias("n"))
    b = balls.groupBy("video_id", "frame_id").count().groupBy("video_id").agg(F.max("count").alias("max_balls"))
    return meta.join(p, "video_id", "left").join(b, "video_id", "left").select("video_id", F.coalesce("max_players", F.lit(0)).alias("max_players"), F.coalesce("max_balls", F.lit(0)).alias("max_balls"), (F.coalesce("n", F.lit(0)) / F.col("total_frames")).alias("mean_players"))


# -- jobs and comments ---------------------------------------------------------------------------------------------------------


def with_columns_of(df: DataFrame, schema: str) -> DataFrame:
    """A table with the columns that a newer schema has, null where they are new."""
    return df.sparkSession.createDataFrame([], schema).unionByName(df, allowMissingColumns=True)


def inserted(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs with new ones (id, video_name, display_name): queued, and stamped with the time in UTC unless they bring one."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = F.coalesce(F.col("created_at"), stamp) if "created_at" in rows.columns else stamp
    new = rows.withColumn("created_at", own).withColumn("status", F.lit("queued")).withColumn("error", F.lit(None).cast("string"))
    return jobs.unionByName(new.select(*jobs.columns))


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("id") == job_id)


def comments_of(comments: DataFrame, job_id: str) -> DataFrame:
    """A job's comments by their time in the video."""
    return comments.where(F.col("job_id") == job_id).orderBy("timestamp_sec", "id")


def progress(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """The last reported stage of each job (rows job_id, at, stage, pct); "" and 0 where none is."""
    last = steps.groupBy(F.col("job_id").alias("id")).agg(F.max_by(F.struct("stage", "pct"), F.struct("at", "pct")).alias("x"))
    return jobs.join(last, "id", "left").select(*jobs.columns, F.coalesce("x.stage", F.lit("")).alias("stage"), F.coalesce("x.pct", F.lit(0.0)).alias("pct"))


def updated(jobs: DataFrame, job_id: str, status: str, error: str | None = None) -> DataFrame:
    hit = F.col("id") == job_id
    message = F.substring(F.lit(error), -500, 500) if error else F.col("error")
    return jobs.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("error", F.when(hit, message).otherwise(F.col("error")))


def newest(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"))


def recovered(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs after a restart: those in work go back to the queue if their file (column id) is there, else fail."""
    there = files.select("id").distinct().withColumn("__f", F.lit(True))
    stuck = F.col("status") == "processing"
    return jobs.join(there, "id", "left").withColumn("status", F.when(stuck & F.col("__f").isNotNull(), "queued").when(stuck, "failed").otherwise(F.col("status"))).drop("__f")


def valid_upload(df: DataFrame) -> DataFrame:
    """Rows with a file name, a known tracker, at most 2 GB and a comment of 1 to 2000 characters that isn't blank (or none)."""
    return df.where(F.col("name").isNotNull() & F.col("tracker").isin("flow", "hungarian", "appearance") & (F.col("size") <= 2 << 30) & (F.col("comment").isNull() | ((F.length("comment") <= 2000) & (F.trim("comment") != ""))))


# -- annotations ---------------------------------------------------------------------------------------------------------------


def unfinished(videos: DataFrame, wanted: DataFrame, annotated: DataFrame) -> DataFrame:
    """Videos with a wanted frame (video_id, physical) that is not annotated."""
    missing = wanted.join(annotated.select("video_id", "physical"), ["video_id", "physical"], "left_anti")
    return videos.join(missing.select("video_id").distinct(), "video_id", "left_semi")


def remapped(annotations: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """Frame columns moved from physical to the nearest logical frames."""
    from ..sources.readers import nearest_logical

    asked = None
    for c in columns:
        one = annotations.where(F.col(c).isNotNull()).select("video_id", F.col(c).cast("long").alias("physical"))
        asked = one if asked is None else asked.unionAll(one)
    near = nearest_logical(frames, asked)
    for c in columns:
        to = near.select("video_id", F.col("physical").alias(c), F.col("logical").alias("__l"))
        annotations = annotations.withColumn(c, F.col(c).cast("long")).join(to, ["video_id", c], "left").withColumn(c, F.col("__l")).drop("__l")
    return annotations


def validation_ids(ids: list, share: float = 0.2, seed: int = 42) -> list:
    """A seeded shuffle's first share, at least one."""
    from random import Random

    order = list(ids)
    Random(seed).shuffle(order)
    return order[: max(1, int(len(order) * share))]


def validation_split(rows: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with ``validation``: true for exactly a share of them (rounded down, at least one), drawn by hashes of the keys and a seed.

    Ranges of hashes are counted and only the range in which the share ends is sorted, so no task holds more than that. The keys must tell rows apart.
    """
    from ..operators.smooth import seeded

    bins = 1 << 16
    drawn = rows.withColumn("__u", seeded(keys, seed)).withColumn("__bin", F.floor(F.col("__u") * bins))
    sizes = drawn.groupBy("__bin").agg(F.count("*").alias("__n"))  # at most ``bins`` rows
    upto = F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    most = F.greatest(F.lit(1), F.floor(F.sum("__n").over(Window.partitionBy()) * F.lit(share)))
    known = sizes.withColumn("__upto", upto).withColumn("__left", most - F.col("__upto") + F.col("__n")).drop("__upto")
    at = drawn.join(F.broadcast(known), "__bin")
    sure = at.where("__left >= __n OR __left <= 0").withColumn("validation", F.col("__left") > 0)
    cut = at.where("__left < __n AND __left > 0")
    rank = F.row_number().over(Window.partitionBy("__bin").orderBy("__u", *keys))
    return sure.unionByName(cut.withColumn("validation", rank <= F.col("__left"))).drop("__u", "__bin", "__n", "__left")


def evaluated(predictions: DataFrame) -> DataFrame:
    """Predictions as evaluation takes them: without untracked rows."""
    return predictions.where("player_id >= 0").withColumnRenamed("player_id", "id")


# -- logs ----------------------------------------------------------------------------------------------------------------------


LOG_SCHEMA = "frame_id long, level string, source string, message string"


def log_append(entries: DataFrame, path: str) -> None:
    """Adds entries to a log; appends are new files, so writers don't disturb each other."""
    entries.select(F.col("frame_id").cast("long"), "level", "source", "message").write.mode("append").parquet(path)


def log_read(spark, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def log_segments(logs: DataFrame, gap: int = 1) -> DataFrame:
    """Runs of frames that have entries of one source and level, at most ``gap`` frames apart."""
    from ..operators.relops import islands, lagged

    keys = ["source", "level"]
    frames = logs.select(*keys, "frame_id").distinct()
    runs = islands(frames, keys, "frame_id", F.col("frame_id") - lagged("frame_id", keys, "frame_id") <= gap)
    return runs.groupBy(*keys, "island").agg(F.min("frame_id").alias("start"), F.max("frame_id").alias("end")).drop("island")


def log_entries(logs: DataFrame, low: int, high: int) -> DataFrame:
    """A frame range's entries as lines."""
    from ..functions.text import log_line

    return logs.where(F.col("frame_id").between(low, high)).select("frame_id", log_line(F.upper("level"), F.col("source"), F.col("message")).alias("line"))
