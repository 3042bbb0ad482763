"""Shot samples in NPZ files: read through Spark's own listing of files, written by a sink whose files appear when the job ends well."""

from __future__ import annotations

import io
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..runtime import register_source, ship

SCHEMA = "path string, frame_id long, h array<double>, rim array<double>, rim_conf double, ball array<double>, ball_conf double"


def sample_rows(path: str, z) -> Iterator[tuple]:
    """The frames of an opened sample; a mask of 0 or a confidence of 0 stands for nothing."""
    for t in range(len(z["homography"])):
        h = z["homography"][t].ravel().tolist() if z["homography_mask"][t] > 0.5 else None
        parts = [(z[f"{k}_bbox"][t].tolist(), float(z[f"{k}_conf"][t])) if z[f"{k}_conf"][t] > 1e-6 else (None, None) for k in ("rim", "ball")]
        yield (path, t, h, *parts[0], *parts[1])


def read_samples(spark: SparkSession, path: str, filters: str = "true") -> DataFrame:
    """All frames of the samples below a folder, of any file system that Spark reads.

    Spark lists the files and packs them into partitions by their bytes; ``filters`` on path, length and modificationTime leave files unread.
    A sample is a clip, so it is small; files that are no samples raise an error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).where(filters).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part.path, part.content):
                with np.load(io.BytesIO(content)) as z:
                    yield pd.DataFrame(list(sample_rows(PurePosixPath(name).name, z)), columns=[c.strip().split(" ")[0] for c in SCHEMA.split(",")])

    return files.mapInPandas(run, SCHEMA)


def write_samples(frames: DataFrame, path: str) -> None:
    """A file for each ``path`` (a name) of the frames, and lines of an index that names them, in a folder that driver and executors have mounted.

    Frames without a row are empty ones. The files and the index appear together when all tasks have ended well; a failed job leaves none.
    """
    register_source(frames.sparkSession, NpzSource)
    os.makedirs(path.removeprefix("file://"), exist_ok=True)
    rows = frames.select(*(c.strip().split(" ")[0] for c in SCHEMA.split(",")))
    rows.repartition("path").sortWithinPartitions("path", "frame_id").write.format("shot_npz").mode("append").save(path.removeprefix("file://"))


class NpzSource(DataSource):
    """`spark.read.format("shot_npz").option("paths", "a.npz,b.npz")`: a partition for each file, by paths that the executors reach; the sink of ``write_samples``."""

    @classmethod
    def name(cls) -> str:
        return "shot_npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["paths"].split(","))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with np.load(partition.value) as z:
            yield from sample_rows(str(PurePosixPath(partition.value)), z)


@dataclass
class Made(WriterCommitMessage):
    folder: str
    samples: list[tuple[str, int]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, os.path.join(path, f".writing-{uuid.uuid4().hex}")
        os.makedirs(self.job)

    def write(self, iterator: Iterator) -> Made:
        folder = os.path.join(self.job, uuid.uuid4().hex)
        os.mkdir(folder)  # fails once the job was given up
        samples: list[tuple[str, int]] = []
        name, rows = None, []
        for row in iterator:
            if row[0] != name:
                if rows:
                    samples.append(self._save(folder, name, rows))
                name, rows = row[0], []
            rows.append(row)
        if rows:
            samples.append(self._save(folder, name, rows))
        return Made(folder, samples)

    @staticmethod
    def _save(folder: str, name: str, rows: list) -> tuple[str, int]:
        if name is None or os.path.basename(name) != name or not name.endswith(".npz"):
            raise ValueError(f"{name!r} is no name of a sample")
        n = max(r[1] for r in rows) + 1
        out = {"homography": np.zeros((n, 3, 3)), "homography_mask": np.zeros(n)} | {f"{k}_{x}": np.zeros((n, 4) if x == "bbox" else n) for k in ("rim", "ball") for x in ("bbox", "conf")}
        for _, t, h, rim, rim_conf, ball, ball_conf in rows:
            if h is not None:
                out["homography"][t], out["homography_mask"][t] = np.reshape(h, (3, 3)), 1
            for k, box, conf in (("rim", rim, rim_conf), ("ball", ball, ball_conf)):
                if box is not None and conf is not None:
                    out[f"{k}_bbox"][t], out[f"{k}_conf"][t] = box, conf
        np.savez_compressed(os.path.join(folder, name), **out)
        return name, n

    def commit(self, messages: list[Made | None]) -> None:
        with open(os.path.join(self.job, "index"), "w") as f:
            for m in messages:
                for name, n in m.samples if m else ():
                    os.replace(os.path.join(m.folder, name), os.path.join(self.path, name))
                    f.write(json.dumps({"sample_path": name, "frame_count": n}) + "\n")
        os.replace(os.path.join(self.job, "index"), os.path.join(self.path, f"index-{os.path.basename(self.job)[9:17]}.jsonl"))
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[Made | None]) -> None:
        for _ in range(20):  # tasks that are being stopped may still write
            shutil.rmtree(self.job, ignore_errors=True)
            if not os.path.exists(self.job):
                break
            time.sleep(0.1)
