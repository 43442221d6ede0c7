"""Aggregates by windows of event time over a stream with late rows.

The watermark trails the latest time seen by what rows may be late. A window is given once, when the watermark has reached its end, and its state goes then; a row is dropped if
it comes when its window has gone. So the state holds the windows that reach beyond the watermark and no others, however long the stream runs.
"""
from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from lodequery.sources.scratch import scratch_folder


def _spelled(length: timedelta) -> str:
    if length < timedelta(0):
        raise ValueError("a length of time can't be negative")
    return f"{length // timedelta(microseconds=1)} microseconds"


def event_windows(stream: DataFrame, time: str, length: timedelta, late: timedelta, by: list[str], aggregates: Mapping[str, Column], slide: timedelta | None = None) -> DataFrame:
    """``start`` and ``end`` of each window, the columns ``by`` and the aggregates, for output mode ``append``; overlapping windows with ``slide``.

    Rows with a null time are in no window. A null in ``by`` is a group like others. Task-local partial aggregation comes before the one shuffle, so a hot group sends a row from each task.
    A time without zone is read in the session's zone, and so are the windows' bounds given back.
    """
    without_zone = isinstance(stream.schema[time].dataType, TimestampNTZType)
    # Only now the columns that are needed go on; the time has a name that no other column has.
    named = stream.withColumn("_event_time", F.col(time).cast("timestamp")).withWatermark("_event_time", _spelled(late))
    window = F.window("_event_time", _spelled(length), _spelled(slide) if slide else None)
    made = named.groupBy(window.alias("_window"), *by).agg(*(a.alias(n) for n, a in aggregates.items()))
    kind = "timestamp_ntz" if without_zone else "timestamp"
    return made.select(F.col("_window.start").cast(kind).alias("start"), F.col("_window.end").cast(kind).alias("end"), *by, *aggregates)


def drained(stream: DataFrame, name: str = "drained") -> tuple[DataFrame, list[dict]]:
    """What a stream gives from all that is there now, in output mode ``append``, written to the shared folder and read again; and the progress of each batch.

    A batch that fails runs again from its checkpoint, and its files count once. Windows that the watermark hasn't reached are left out.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, name)
    running = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), [p if isinstance(p, dict) else p.jsonValue for p in running.recentProgress]
