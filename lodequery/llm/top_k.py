"""Exact top-k search by inner product: aggregation over sorted lists without random access.

Every vector is a whole number for each dimension. A task gathers the candidates that it reads into shards of at most SHARD vectors and makes, for every
dimension of a shard, the list of its vectors in the order of their values. Queries lie in files in the shared folder; each task streams them past each
of its shards, a batch at a time, so neither side is ever whole anywhere, and nothing but results is shuffled.

One query in one shard. Where its component is positive, a list is read from its high end, where it is negative from its low end, where it is zero not at
all. All lists are read on in step, one after the other in runs, each run twice the depth before. What has been read of a vector is added up. What hasn't been read is bounded: by
the value at which its list stands now (at most that), and by the value at the list's far end (at least that). The k-th highest lower bound is a mark;
a vector whose upper bound is below it can't qualify any more. When so few are left that the outsiders don't matter (RESOLVE), or the lists are at their ends, reading stops, and the
scores of those left are made whole. Bounds for all vectors come from tables of partial sums by eight dimensions at a time.

Defined results: vectors that are null, empty included, or hold a null or a component that isn't finite take no part (an empty one has no component: it is compared with
empty ones only, score 0); a query is compared with vectors of as many components; equal scores go by the smaller id, a null id after all others; a repeated
row is a query and a candidate of its own, so another row of a query's id is one of its candidates; a null id is no query; empty tables give no rows; scores that could pass 64 bits raise
OverflowError. Other columns are never read.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.llm.shared import filesystem, small_batches, written_to

#: Candidates of a shard: bounds a task's memory.
SHARD = 1 << 16
#: Candidates that are left to be resolved, and the part of a list that the first run reads.
RESOLVE, FIRST = 64, 1 / 16
NO_ID = (1 << 63) - 1


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


class Shard:
    """Candidates with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        by_id = np.lexsort((rows, ids))  # then equal scores are in order of the id
        self.ids, self.rows, self.vectors = ids[by_id], rows[by_id], vectors[by_id]
        self.n, self.dims = vectors.shape
        self.most = int(np.abs(vectors).max(initial=0))
        order = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)
        self.order = np.ascontiguousarray(order)
        self.values = np.take_along_axis(np.ascontiguousarray(self.vectors.T), self.order, axis=1)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best candidates but the row ``own``, best first."""
        if self.dims * self.most * int(np.abs(query).max(initial=0)) >= 1 << 62:
            raise OverflowError("an inner product could pass 64 bits")
        left = self._left(query, k + 1)
        left = left[self.rows[left] != own]
        scores = self.vectors[left] @ query
        first = np.argsort(-scores, kind="stable")[:k]
        return left[first], scores[first]

    def _left(self, query: np.ndarray, k: int) -> np.ndarray:
        """Places, in order, of candidates that may be among the k best."""
        read = np.flatnonzero(query)
        left = np.arange(self.n)
        if not len(read) or self.n <= max(k, RESOLVE):
            return left
        known = np.zeros(self.n, np.int64)
        seen = np.zeros((-(-len(read) // 8), self.n), np.uint8)  # a bit for each list, eight lists a byte
        weights, depth, step = query[read], 0, max(k, int(self.n * FIRST))
        far = weights * np.where(weights > 0, self.values[read, 0], self.values[read, -1])  # the least that a list can give
        while depth < self.n:
            end = min(self.n, depth + step)
            for j, (d, w) in enumerate(zip(read.tolist(), weights.tolist(), strict=True)):
                run = slice(self.n - end, self.n - depth) if w > 0 else slice(depth, end)
                docs = self.order[d, run]
                known[docs] += w * self.values[d, run]
                seen[j >> 3, docs] |= 1 << (j & 7)
            if end == self.n:
                lower = upper = known[left]
            else:
                now = weights * np.where(weights > 0, self.values[read, self.n - end], self.values[read, end - 1])
                lower = known[left] + _unseen(far, seen[:, left])
                upper = known[left] + _unseen(now, seen[:, left])
            mark = np.partition(lower, len(lower) - k)[len(lower) - k]
            left = left[upper >= mark]
            if len(left) <= max(k, RESOLVE):
                break
            step, depth = end, end
        return left


def _unseen(each: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For every candidate the sum of ``each`` over the lists in which it hasn't been seen."""
    total = np.zeros(seen.shape[1], np.int64)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") == 0
    for g, row in enumerate(seen):
        part = np.zeros(8, np.int64)
        part[: len(each[8 * g : 8 * g + 8])] = each[8 * g : 8 * g + 8]
        total += (bits @ part)[row]
    return total


def _arrays(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _queries(folder: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(id, row, vector) of the queries written to a folder, a batch of a file at a time."""
    fs, path = filesystem(folder)
    from pyarrow.fs import FileSelector

    for info in sorted(fs.get_file_info(FileSelector(path)), key=lambda f: f.path):
        if info.base_name.startswith(("_", ".")):
            continue
        with fs.open_input_file(info.path) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=4096, columns=["id", "row", "q"]):
                vectors = b.column(2)
                for i, (key, row) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    yield key, row, vectors[i].values.to_numpy()


def search(df: DataFrame, id_col: str, vector_col: str, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank`` (from 1), id_col and ``score``: the k candidates of highest inner product of each query, a row whose id is divisible by ``every``."""
    spark = df.sparkSession
    small_batches(spark)
    vector = F.col(f"`{vector_col}`")
    vectors = df.filter(usable(vector)).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole(vector, scale).alias("q")).withColumn("row", F.monotonically_increasing_id())
    vectors, _ = written_to(vectors, "vectors")
    _, folder = written_to(vectors.filter(F.col("id") % every == 0), "queries")
    n = vectors.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD))
    schema = pa.schema([("query", pa.int64()), ("query_row", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)  # by the number of components
        sizes: dict[int, int] = defaultdict(int)
        for b in batches:
            lengths = b.column("q").value_lengths().to_numpy()
            for n in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == n)) if (lengths != n).any() else b
                for a in range(0, part.num_rows, SHARD):
                    held[n].append(part.slice(a, SHARD))
                    sizes[n] += held[n][-1].num_rows
                    if sizes[n] >= SHARD:
                        yield from found(held.pop(n))
                        sizes[n] = 0
        for n in list(held):
            yield from found(held.pop(n))

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        shard = Shard(rows["id"].fill_null(NO_ID).to_numpy(), rows["row"].to_numpy(), np.concatenate([_arrays(p.column("q")) for p in parts]))
        no_id = set(rows.filter(rows["id"].is_null())["row"].to_pylist())
        out, size = [], 0
        for key, row, q in _queries(folder):
            if len(q) != shard.dims:
                continue
            at, scores = shard.best(q, row, k)
            out.append((np.full(len(at), key), np.full(len(at), row), shard.ids[at], shard.rows[at], scores))
            size += len(at)
            if size >= 1 << 15:
                yield batch(out, no_id)
                out, size = [], 0
        if out:
            yield batch(out, no_id)

    def batch(out: list[tuple], no_id: set[int]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        masks = [None, None, np.isin(columns[3], list(no_id)) if no_id else None, None, None]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=m) for c, m in zip(columns, masks, strict=True)], schema=schema)

    near = vectors.repartition(tasks).mapInArrow(run, "query long, query_row long, id long, row long, score long")
    order = Window.partitionBy("query", "query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
