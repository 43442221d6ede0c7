"""Reading and appending tables. A table is one Parquet file or folder named ``<table>.parquet``.

A table of inserts is a folder with a folder for each insert, named by its key. An insert is written aside first, where readers don't look, and
takes effect by a rename; where the key's folder is there already, what was written aside goes. So an insert that is tried again, after whatever failure, leaves
its rows once, and readers see all of them or none. That holds on file systems whose rename of a folder is one step (local, HDFS).
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Rows of a batch sent to Python: bounds a worker's memory where texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark reads it: no inference pass, so pruning and pushdown reach the scan.

    Raises ValueError for a name that isn't a known table.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, one or a folder of them; those that come later are taken, too, if it is a folder."""
    schema = load_table(spark, sf_dir, name).schema
    # Only a pattern may stand for a single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def append_row(df: DataFrame, row: Mapping[str, object]) -> DataFrame:
    """``df`` with one more row, as a plan (nothing is written). Fields left out are null; unknown fields raise ValueError."""
    if unknown := set(row) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    values = tuple(row.get(c) for c in df.columns)
    return df.unionByName(df.sparkSession.createDataFrame([values], df.schema))


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write to Parquet; ``append`` keeps the rows that are there."""
    df.write.mode(mode).parquet(path)


def insert_once(df: DataFrame, path: str, key: str) -> bool:
    """Add the rows of ``df`` to a table of inserts, unless an insert of this key is there; whether they were added."""
    spark = df.sparkSession
    name = hashlib.sha256(key.encode()).hexdigest()
    of = spark._jvm.org.apache.hadoop.fs.Path
    aside, own = of(f"{path}/_{name}-{uuid.uuid4().hex}"), of(f"{path}/{name}")
    files = own.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(own):
        return False
    try:
        df.write.parquet(aside.toString())
        # Where another one was quicker, a rename fails or moves the folder into the other's, under a name that readers leave out.
        return files.rename(aside, own) and not files.delete(of(own, aside.getName()), True)
    finally:
        files.delete(aside, True)


def inserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of a table of inserts."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
