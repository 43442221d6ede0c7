"""Best-fit packing of tokenized documents into sequences of bounded length.

Bounded-space online best-fit: a task keeps at most OPEN_BINS open bins, found by their free space
through a bitset (bit f is set while some open bin has f tokens free), so the best bin for a piece is
the lowest set bit at or above its length. When one more bin is needed than may be open, the fullest
closes first. The pieces of one batch of rows are placed longest first. Documents longer than a sequence are cut so that only the first piece is shorter.

Each task packs what it reads, without a shuffle. What tasks leave open is packed again in rounds: the open bins
of FAN tasks become the items of one group, largest first, and so on until one group is left. A
group holds FAN * OPEN_BINS rows at most, whatever the input's size. A bin moves as a whole, so a piece's
place changes by one offset, which a join on the bin brings back to the pieces.

Defined results: a null text is an empty one and has only the end id; a document without any id (no end id and no text) has no piece;
a text of any length is cut into pieces of its ids; repeated rows are packed each; an empty table gives no pieces. Columns other than the two named are never read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from lodequery.llm.shared import batched, small_batches, written
from lodequery.llm.token_ids import token_ids

OPEN_BINS = 256
FAN = 64


class BestFit:
    """Places items, in the order they come, into bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self._capacity, self._most, self._open, self._new = capacity, open_bins, 0, 0
        self._free = 0  # bit f: some open bin has f free
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of an item of 1 to capacity."""
        fitting = self._free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            if self._open == self._most and length < self._capacity:  # a full bin never is an open one
                self._take((self._free & -self._free).bit_length() - 1)  # the fullest closes
            free, b = self._capacity, self._new
            self._new += 1
        if free > length:
            self._bins[free - length].append(b)
            self._free |= 1 << (free - length)
            self._open += 1
        return b, self._capacity - free

    def _take(self, free: int) -> int:
        b = self._bins[free].pop()
        self._open -= 1
        if not self._bins[free]:
            self._free &= ~(1 << free)
        return b

    def left(self) -> Iterator[tuple[int, int]]:
        """(bin, tokens in it) of the bins that are open."""
        return ((b, self._capacity - free) for free, bins in enumerate(self._bins) for b in bins)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(a, capacity) for a in range(first, n, capacity)]


_PIECES = [("piece", IntegerType(), pa.int32()), *((c, LongType(), pa.int64()) for c in ("start", "length", "ids_crc32", "part", "bin", "offset"))]
_BIN = "part long, bin long, used long, members array<struct<part:long,bin:long,shift:long>>, closed boolean"


def _packed(df: DataFrame, id_col: str, text_col: str, tokenizer: str, kind: str, end_id: int | None, capacity: int, open_bins: int, with_ids: bool) -> DataFrame:
    """Pieces by task; a row with offset -1 for each bin that a task left open, its tokens in length."""
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *(StructField(c, t) for c, t, _ in _PIECES), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, bins = TaskContext.get().partitionId(), token_ids(tokenizer, kind), BestFit(capacity, open_bins)
        last = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        out = None
        for b in batches:
            out = pa.schema([(id_col, b.schema.field(0).type), *((c, t) for c, _, t in _PIECES), ("ids", pa.binary())])
            yield from batched(pieces(b, part, encoder, last, bins), out)
        if out is not None:
            yield from batched(((None, None, None, used, None, part, b, -1, None) for b, used in bins.left()), out)

    def pieces(b: pa.RecordBatch, part: int, encoder, last: bytes, bins: BestFit) -> Iterator[tuple]:
        found = [ids + last for ids in encoder.encode_many(b.column(1).to_pylist())]
        rows = [(d, k, start, n) for d, ids in enumerate(found) for k, (start, n) in enumerate(cut(len(ids) // 4, capacity))]
        rows.sort(key=lambda r: -r[3])  # of what is at hand, the longest first
        keys = b.column(0).to_pylist()
        for d, k, start, n in rows:
            body = found[d][4 * start : 4 * (start + n)]
            yield keys[d], k, start, n, zlib.crc32(body), part, *bins.place(n), body if with_ids else None

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _repack(capacity: int, open_bins: int, fan: int, last: bool):
    """Packs the open bins of one group of fan tasks or groups."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["used", "part", "bin"], ascending=[False, True, True])
        bins, members, used = BestFit(capacity, open_bins), {}, {}
        for n, inside in zip(rows["used"].tolist(), rows["members"].tolist(), strict=True):
            b, offset = bins.place(n)
            members.setdefault(b, []).extend({"part": m["part"], "bin": m["bin"], "shift": m["shift"] + offset} for m in inside)
            used[b] = offset + n
        still = set() if last else {b for b, _ in bins.left()}
        group = int(rows["part"].iloc[0]) // fan
        return pd.DataFrame({"part": group, "bin": list(members), "used": [used[b] for b in members], "members": list(members.values()), "closed": [b not in still for b in members]})

    return pack


def pack_documents(
    df: DataFrame, id_col: str, text_col: str, tokenizer: str, kind: str, end_id: int | None,
    capacity: int = 2048, open_bins: int = OPEN_BINS, fan: int = FAN, with_ids: bool = False,
) -> DataFrame:
    """A row per piece: id_col, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, if asked for, ``ids``."""
    small_batches(df.sparkSession)
    packed = written(_packed(df, id_col, text_col, tokenizer, kind, end_id, capacity, open_bins, with_ids), "packed")
    pieces = packed.filter("offset >= 0")
    opened = packed.filter("offset < 0").select(
        "part", "bin", F.col("length").alias("used"), F.array(F.struct("part", "bin", F.lit(0).cast("long").alias("shift"))).alias("members")
    )
    tasks, level, done = (packed.agg(F.max("part")).first()[0] or 0) + 1, 0, []
    while True:
        level, tasks = level + 1, -(-tasks // fan)
        grouped = opened.groupBy(F.floor(F.col("part") / fan).alias("group"))
        again = written(grouped.applyInPandas(_repack(capacity, open_bins, fan, tasks == 1), _BIN), "repacked")
        done.append(again.filter("closed").select(F.lit(level).alias("level"), "part", "bin", "members"))
        if tasks == 1:
            break
        opened = again.filter("NOT closed").drop("closed")
    moved = done[0]
    for d in done[1:]:
        moved = moved.unionByName(d)
    # Ids of sequences that tasks closed are task and bin; those of later rounds stand above them, by round.
    number = F.expr("level * (1L << 56) + part * (1L << 32) + bin")
    moved = moved.select(number.alias("to"), F.explode("members").alias("m")).select(F.col("m.part").alias("part"), F.col("m.bin").alias("bin"), F.col("m.shift").alias("shift"), "to")
    return pieces.join(moved, ["part", "bin"], "left").select(
        id_col, "piece", "start", "length", "ids_crc32",
        F.coalesce("to", F.expr("part * (1L << 32) + bin")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )
