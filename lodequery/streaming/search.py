"""The same searches over a growing folder of Parquet files: a search is a filter, so it needs no state. Waiting for rows is a stream that ends."""
from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodequery.operators.criteria import Search
from lodequery.operators.summary import record_count
from lodequery.sources.scratch import remove, scratch_folder


def stream_search(spark: SparkSession, folder: str, schema: StructType, search: Search) -> DataFrame:
    """Matching rows of each new file."""
    return search.apply(spark.readStream.schema(schema).parquet(folder))


def stream_count(spark: SparkSession, folder: str, schema: StructType, search: Search) -> DataFrame:
    """The running number of matches; its state is one row (output mode ``complete``)."""
    return record_count(stream_search(spark, folder, schema, search))


def wait_for_rows(spark: SparkSession, folder: str, schema: StructType, search: Search, seconds: float, rows: int = 1) -> int:
    """Waits until the files in a folder, those that are there and those that come, hold this many matching rows, or the time is over; the number found.

    A batch that runs again after a failure counts once; a stream that fails raises its error.
    """
    counts: dict[int, int] = {}
    enough = threading.Event()

    def counted(batch: DataFrame, number: int) -> None:
        counts[number] = batch.count()
        if sum(counts.values()) >= rows:
            enough.set()

    checkpoint, end = scratch_folder(spark, "wait"), time.monotonic() + seconds
    waiting = stream_search(spark, folder, schema, search).writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).start()
    try:
        while not enough.is_set() and (left := end - time.monotonic()) > 0:
            waiting.awaitTermination(min(left, 0.2))
    finally:
        waiting.stop()
        remove(spark, checkpoint)
    return sum(counts.values())
