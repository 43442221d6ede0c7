"""Folders that the driver and all executors see, files in them, and the Arrow plumbing of the operators."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from lodequery.sources.scratch import scratch_folder as new_folder
from lodequery.sources.tables import BATCH_ROWS, small_batches  # noqa: F401


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, of a kind that pyarrow.fs opens, and the path in it."""
    uri = re.sub("^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps don't depend on executors staying alive."""
    return written_to(df, name)[0]


def written_to(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), and the folder that it was written to."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def one_task_each(spark: SparkSession, items: list) -> DataFrame:
    """A row with the place in ``items`` for each of them, each in a task of its own, in order."""
    n = len(items)
    return spark.range(0, n, 1, max(1, n))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values, a batch at a time."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, cut at a number of rows or of bytes in their strings and binaries."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= max_rows or size >= max_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
