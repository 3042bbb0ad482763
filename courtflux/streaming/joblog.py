"""Jobs as a log of events: an idempotent sink, the latest state by aggregation, compaction, and recovery from the log alone.

A log is a folder. Each micro-batch is one folder of events named by its writer and number, so a batch that is replayed after a failure
writes over itself and changes nothing. The state of a job is what its latest events say, column by column: an update carries only the
columns that it changes. Compaction writes the state and the batches that it holds as a snapshot in a folder of its own; readers take the
newest whole snapshot and the batches beyond it, so it doesn't matter where a compaction breaks off. Nothing is ever rewritten in place.

Defined results: of events with equal times the later batch counts, then the larger ``seq``. Events without a job_id are dropped; updates of
a job that was never inserted make a job without names. Columns besides ``EVENT``'s are dropped, missing ones are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import _parse_datatype_string

from ..runtime import written

#: What an event may say; null columns say nothing.
STATE = ["status", "video_name", "display_name", "created_at", "error"]
EVENT = "job_id string, at timestamp, seq long, " + ", ".join(f"{c} string" for c in STATE)
_SEEN = f"{EVENT}, writer string, batch long"


class JobLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- writing ---------------------------------------------------------------------------------------------------------------

    def append(self, events: DataFrame, batch: int, writer: str = "main") -> None:
        """Writes a batch; the same batch of the same writer again replaces itself. Numbers of a writer's batches ascend."""
        have = set(events.columns)
        rows = events.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(EVENT))).where("job_id is not null")
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/writer={writer}/batch={batch}")

    def sink(self, stream: DataFrame, checkpoint: str, writer: str = "main", **trigger) -> StreamingQuery:
        """A stream of events into the log; the stream's checkpoint numbers the batches, and says which one to replay after a failure."""
        started = stream.writeStream.foreachBatch(lambda df, batch: self.append(df, batch, writer)).option("checkpointLocation", checkpoint)
        return (started.trigger(**trigger) if trigger else started).start()

    def recover(self, files: DataFrame, batch: int, writer: str = "recovery") -> None:
        """After a restart: jobs in work go back to the queue if their file (column id) is there, else fail, by events just behind their last.

        The same recovery again finds what it found the first time, as its own events have no part in it.
        """
        known = self.events().where((F.col("writer") != writer) | (F.col("batch") < batch))
        stuck = self.jobs(known).where("status = 'processing'")
        there = files.select("id").distinct().withColumn("__there", F.lit(True))
        last = known.groupBy(F.col("job_id").alias("id")).agg((F.max("at") + F.expr("INTERVAL 1 MICROSECOND")).alias("at"))
        moved = stuck.select("id").join(there, "id", "left").join(last, "id")
        gone = F.col("__there").isNull()
        events = moved.select(F.col("id").alias("job_id"), "at", F.when(gone, "failed").otherwise("queued").alias("status"), F.when(gone, "the file is gone").alias("error"))
        self.append(written(events), batch, writer)

    # -- reading ---------------------------------------------------------------------------------------------------------------

    def _folders(self, below: str) -> list[str]:
        """Names in a folder of the log, of whole ones if they are written by Spark."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _whole(self, below: str) -> bool:
        return "_SUCCESS" in self._folders(below)

    def snapshot(self) -> int | None:
        """The number of the newest whole snapshot."""
        known = sorted((int(n.split("=")[1]) for n in self._folders("snapshots")), reverse=True)
        return next((n for n in known if self._whole(f"snapshots/n={n}/state") and self._whole(f"snapshots/n={n}/held")), None)

    def _batches(self) -> list[tuple[str, int]]:
        return [(w.split("=")[1], int(b.split("=")[1])) for w in self._folders("batches") for b in self._folders(f"batches/{w}") if self._whole(f"batches/{w}/{b}")]

    def _held(self, n: int | None) -> dict[str, int]:
        """How far a snapshot goes: the last batch of each writer."""
        return {} if n is None else {r.writer: r.batch for r in self.spark.read.schema("writer string, batch long").parquet(f"{self.path}/snapshots/n={n}/held").collect()}

    def events(self) -> DataFrame:
        """The newest snapshot's rows, one a job and column set, and all events beyond it."""
        n = self.snapshot()
        held = self._held(n)
        rest = [f"{self.path}/batches/writer={w}/batch={b}" for w, b in self._batches() if b > held.get(w, -1)]
        rows = self.spark.createDataFrame([], _SEEN)
        if rest:
            rows = rows.unionByName(self.spark.read.schema(_SEEN).option("basePath", f"{self.path}/batches").parquet(*rest))
        if n is not None:
            rows = rows.unionByName(self.spark.read.schema(_SEEN).parquet(f"{self.path}/snapshots/n={n}/state"))
        return rows

    def jobs(self, events: DataFrame | None = None) -> DataFrame:
        """id and the state's columns: of each column what the latest of the events (else of all) that says anything says."""
        order = F.struct("at", "batch", "seq", "writer")
        latest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in STATE]
        return (self.events() if events is None else events).groupBy(F.col("job_id").alias("id")).agg(*latest)

    # -- compaction ------------------------------------------------------------------------------------------------------------

    def compact(self) -> None:
        """Writes a snapshot of what is there, then drops what it holds. A column keeps the time of its own last event."""
        before, found = self.snapshot(), self._batches()
        held = self._held(before)
        for w, b in found:
            held[w] = max(b, held.get(w, -1))
        own = F.struct("at", "batch", "seq", "writer")
        last = self.events().groupBy("job_id").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(own.alias("o"), F.col(c).alias("v")))).alias(c) for c in STATE))
        n = (before or 0) + 1
        # One row for each time at which a job's columns were last set.
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"{c}.o").alias("o"), F.col(f"{c}.v").alias("v")) for c in STATE))).alias("x")
        long = last.select("job_id", each).where("x.v is not null").select("job_id", "x.*")
        wide = long.groupBy("job_id", "o").agg(*(F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in STATE))
        wide.select("job_id", "o.at", "o.seq", *STATE, "o.writer", "o.batch").write.mode("overwrite").parquet(f"{self.path}/snapshots/n={n}/state")
        self.spark.createDataFrame(list(held.items()), "writer string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/n={n}/held")
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for gone in [f"batches/writer={w}/batch={b}" for w, b in found] + ([] if before is None else [f"snapshots/n={before}"]):
            p = jvm.Path(f"{self.path}/{gone}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
