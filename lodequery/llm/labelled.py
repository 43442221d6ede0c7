"""Counts of labelled documents for fitting, of a bounded number of rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodequery.llm.shared import small_batches
from lodequery.llm.text_stats import NAMES, counts_of

#: Labelled rows that a fit reads at most; those with the least hash of their id.
MOST_LABELS = 20_000


def held_out(id_col: Column) -> Column:
    """Whether a document's label may not be learnt from; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """id_col, the columns in keep and the counts of NAMES for every row, from its whole text."""
    small_batches(df.sparkSession)
    cols = [id_col, *keep]
    fields = [*(df.schema[c] for c in cols), *(StructField(n, LongType()) for n in NAMES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = counts_of(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, counts.T)], [*cols, *NAMES])

    return df.select(text_col, *cols).mapInArrow(run, StructType(fields))


def labelled_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = MOST_LABELS) -> DataFrame:
    """id_col, text_col and ``_label`` (0 or 1) of the rows with one of ``most`` ids whose label may be learnt from, those with the least hash.

    The labels taken are bounded before they are sent to the executors, so their broadcast is, too.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    taken = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return df.select(id_col, text_col).join(F.broadcast(taken), F.col(id_col) == F.col("_id")).select(id_col, text_col, "_label")


def labelled_counts(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = MOST_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """(counts, labels 0 or 1) of at most ``most`` rows whose label may be learnt from, in the order of a hash of their ids."""
    rows = labelled_rows(df, labels, id_col, text_col, label_col, most)
    found = with_counts(rows, id_col, text_col, ["_label"]).orderBy(F.xxhash64(id_col), id_col, *NAMES).limit(most).collect()
    counts = np.array([[r[n] for n in NAMES] for r in found], np.int64).reshape(-1, len(NAMES))
    return counts, np.array([r["_label"] for r in found], np.int64)
