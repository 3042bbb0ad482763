"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop, scratch, ship

#: Bytes of text that one step of a vectorised Python function handles; bounds its temporary arrays.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in the cluster's shared folder; a local one only in a local session that names none."""
    return scratch(spark)


def drop_dir(spark: SparkSession, path: str) -> None:
    drop(spark, path)


def written(df: DataFrame, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_value(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def crc_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text (0)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def crc_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(text)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_text(df: DataFrame, columns: list[str], schema: str, f: Callable[[pa.RecordBatch], dict | None], most: int = SLICE_BYTES) -> DataFrame:
    """Applies ``f`` to slices of the named columns; ``f`` returns columns of the output schema."""
    spark = df.sparkSession
    ship(spark)
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=most):
                got = f(part)
                if got is not None:
                    yield as_batch(got, out)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        v = columns[field.name]
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        arrays.append(v.cast(field.type) if isinstance(v, pa.Array) else pa.array(v, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def keep_rows(df: DataFrame, decide: Callable[[pa.RecordBatch], np.ndarray], most: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``decide`` says true; no shuffle."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=most):
                yield part.filter(pa.array(decide(part), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def utf8_list(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return col.cast(pa.binary()).fill_null(b"").to_pylist()


def text_list(col: pa.Array) -> list[str]:
    return col.fill_null("").to_pylist()
