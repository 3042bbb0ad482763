"""Session helpers."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    fd, path = tempfile.mkstemp(prefix=f"{top.name}-", suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


@contextmanager
def by_value() -> Iterator[None]:
    """Within it, code of this package is pickled itself instead of by name, for Spark's driver-side workers, which don't have what ``ship`` sends."""
    package = sys.modules[__name__.split(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def register_source(spark: SparkSession, source: type) -> None:
    """Makes a Python data source of this package known to the session."""
    ship(spark)
    with by_value():
        spark.dataSource.register(source)


_folders: dict[str, set[str]] = {}
_local: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the cluster's shared folder (``spark.checkpoint.dir``); it goes when the driver ends.

    Only a local session may do without a shared folder: there it is one of this machine.
    """
    app = spark.sparkContext.applicationId
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="courtflux-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        root = _local[app]
    path = f"{root.rstrip('/')}/courtflux-{uuid.uuid4().hex}"
    if app not in _folders:
        _folders[app] = set()
        atexit.register(_drop_all, spark, app)
    _folders[app].add(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, is made once however often it is read, and outlives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _folders.get(spark.sparkContext.applicationId, set()).discard(path)


def _drop_all(spark: SparkSession, app: str) -> None:
    for path in list(_folders.pop(app, ())):
        with suppress(Exception):  # a session that was stopped has no file system any more
            drop(spark, path)
