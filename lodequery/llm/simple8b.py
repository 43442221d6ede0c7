"""Token ids in files of word-aligned Simple-8b blocks, with random access by id and by document.

A 64-bit word is a 4-bit selector over 60 bits of payload; selector s packs COUNT[s] ids of WIDTH[s] bits.
Ids of 60 bits and more are escapes: the word's payload is the place of the id among the block's raw words.
A file is MAGIC, the blocks of BLOCK ids each (the last may be shorter), the footer and its length. A block's
words stand in front of its escapes. The footer lists where blocks begin and how many words and escapes they
have, and each document's key and number of ids, in the order of their keys. Decoding a block needs no loop over words:
the counts' running sum places every word's ids, one selector at a time.

Files come from range partitions, so file order is key order; where a file starts among all ids is the sum
over the files before it, of which there is one row a file. The number of tasks follows the texts' bytes, and a task begins a new file after
FILE_DOCS documents or FILE_IDS ids, so footers stay small. Rows of one key (or of none) are dealt by the beginnings of their texts, too.

Defined results: a null text is an empty one and has only the end id; null keys come first; rows with equal keys stand in the
order of their texts; an empty table makes no files and no rows; a very long text is encoded whole, its ids going over as many blocks as they need.
Columns other than the two named are never read.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lodequery.llm.shared import batched, filesystem, new_folder, one_task_each, small_batches
from lodequery.llm.token_ids import token_ids

MAGIC = b"S8BLOCK1"
BLOCK = 1 << 16
#: A file has so many documents at most, and begins no further one after so many ids; a task has about so many bytes of text.
FILE_DOCS, FILE_IDS, TASK_BYTES = 1_000_000, 1 << 28, 1 << 28
#: Documents whose footer entries are Python objects at a time, and code points of a text that tell rows of one key apart.
FOOTER_DOCS, PREFIX = 1 << 16, 32
#: The packings of 60 bits, most ids first; the last selector is the escape.
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = len(COUNT) - 1


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes), both unsigned 64-bit, of unsigned 64-bit ids. At each id the packing that takes most is chosen."""
    n = len(ids)
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(COUNT[0], np.uint64)])
    bits = np.zeros(len(padded), np.int8)
    for width in WIDTH[:-1]:
        bits += padded >= (np.uint64(1) << np.uint64(width))  # how many of the widths are too small
    choice = np.full(len(padded), ESCAPE, np.int8)
    for s in range(ESCAPE - 1, -1, -1):
        small, others = np.flatnonzero(bits <= s), int(COUNT[s]) - 1
        if len(small) > others:
            # COUNT[s] small ids in a row: the one that many places on in the list is that many places on in the block.
            choice[small[: len(small) - others][small[others:] - small[: len(small) - others] == others]] = s
    choice = choice[:n].astype(np.int64)
    steps, at, starts = COUNT[choice].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    picked = choice[starts]
    words, escapes = np.zeros(len(starts), np.uint64), np.zeros(0, np.uint64)
    for s in np.unique(picked):
        mine = picked == s
        if s == ESCAPE:
            escapes = padded[starts[mine]]
            body = np.arange(len(escapes), dtype=np.uint64)
        else:
            shifts = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64)
            body = (padded[starts[mine][:, None] + np.arange(COUNT[s])] << shifts).sum(axis=1, dtype=np.uint64)
        words[mine] = body | (np.uint64(s) << np.uint64(60))
    return words, escapes


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The block's n ids, unsigned 64-bit."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNT[selectors])
    begins = ends - COUNT[selectors]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selectors):
        mine = selectors == s
        if s == ESCAPE:
            out[begins[mine]] = escapes[body[mine].astype(np.int64)]
        else:
            shifts = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64)
            out[begins[mine][:, None] + np.arange(COUNT[s])] = (body[mine][:, None] >> shifts) & np.uint64((1 << int(WIDTH[s])) - 1)
    return out[:n]


#: A document in a footer.
_DOCS = pa.schema([("key", pa.int64()), ("n_ids", pa.int64())])


class Writer:
    """Appends documents' ids to a stream, a block at a time."""

    def __init__(self, stream):
        self._out, self._held, self._n_held, self.n_ids = stream, [], 0, 0
        self._blocks, self._keys, self._counts, self._at = [], [], [], len(MAGIC)
        self._listed: list[pa.RecordBatch] = []
        stream.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self._keys.append(key)
        self._counts.append(len(ids))
        self._held.append(ids)
        self._n_held += len(ids)
        self.n_ids += len(ids)
        if self._n_held >= BLOCK:
            self._flush(False)
        if len(self._keys) == FOOTER_DOCS:
            self._list()

    def _list(self) -> None:
        self._listed.append(pa.RecordBatch.from_arrays([pa.array(self._keys, pa.int64()), pa.array(self._counts, pa.int64())], schema=_DOCS))
        self._keys, self._counts = [], []

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self._held) if self._held else np.zeros(0, np.uint64)
        for a in range(0, len(ids) if rest else len(ids) - BLOCK + 1, BLOCK):
            words, escapes = encode_block(ids[a : a + BLOCK])
            self._blocks.append((self._at, len(words), len(escapes)))
            self._at += self._out.write(words.astype("<u8").tobytes()) + self._out.write(escapes.astype("<u8").tobytes())
        left = ids[len(ids) // BLOCK * BLOCK :]
        self._held, self._n_held = [left], len(left)

    def close(self) -> None:
        if self._n_held:
            self._flush(True)
        self._list()
        footer = pa.BufferOutputStream()
        tables = (
            pa.Table.from_batches(self._listed),
            pa.table(dict(zip(("at", "words", "escapes"), (pa.array(c, pa.int64()) for c in (zip(*self._blocks, strict=True) if self._blocks else ([], [], []))), strict=True))),
        )
        for t in tables:
            with pa.ipc.new_stream(footer, t.schema) as w:
                w.write_table(t)
        body = footer.getvalue()
        self._out.write(body)
        self._out.write(len(body).to_bytes(8, "little"))
        self._out.write(MAGIC)


class Reader:
    """Documents of a seekable file: all in order, or ids from any place."""

    def __init__(self, file):
        self._file = file
        size = file.seek(0, 2)
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a Simple-8b file, or cut short")
        length = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - length)
        footer = pa.py_buffer(file.read(length))
        source = pa.BufferReader(footer)
        docs, blocks = pa.ipc.open_stream(source).read_all(), pa.ipc.open_stream(source).read_all()
        self.keys, self.counts = docs["key"], docs["n_ids"].to_numpy()
        self.starts = np.cumsum(self.counts) - self.counts
        self._blocks = list(zip(*(blocks[c].to_pylist() for c in ("at", "words", "escapes")), strict=True))
        self.n_ids = int(self.counts.sum())
        self._last = (-1, None)

    def _block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            at, words, escapes = self._blocks[k]
            self._file.seek(at)
            raw = np.frombuffer(self._file.read(8 * (words + escapes)), "<u8")
            self._last = (k, decode_block(raw[:words], raw[words:], min(BLOCK, self.n_ids - k * BLOCK)))
        return self._last[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start; only their blocks are read."""
        parts = [self._block(k)[max(0, start - k * BLOCK) : start + n - k * BLOCK] for k in range(start // BLOCK, (start + n - 1) // BLOCK + 1)] if n else []
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, place of its first id in the file, ids) in file order."""
        for a in range(0, len(self.keys), FOOTER_DOCS):
            part = slice(a, a + FOOTER_DOCS)
            for key, start, n in zip(self.keys[part].to_pylist(), self.starts[part].tolist(), self.counts[part].tolist(), strict=True):
                yield key, start, self.ids(start, n)


def write_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: str, kind: str, end_id: int | None, folder: str) -> list[tuple[str, int, int]]:
    """Encode every text, append end_id, and write files in ascending order of id_col (an integer); (file, documents, ids) of each, in order.

    One shuffle, by ranges of the key and the beginning of the text. A task writes under names of its own and only the names that come
    back from tasks that ended well are used, so lost executors and repeated tasks leave nothing in the result.
    """
    spark = df.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, number = token_ids(tokenizer, kind), TaskContext.get().partitionId(), 0
        last = np.zeros(0, np.uint64) if end_id is None else np.array([end_id], np.uint64)
        fs, path = filesystem(folder)
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), encoder.encode_many(b.column(1).to_pylist()), strict=True))
        row = next(rows, None)
        while row is not None:
            name, docs = f"{task:08d}-{number:06d}-{uuid.uuid4().hex}.s8b", 0
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{name}") as stream:
                writer = Writer(stream)
                while row is not None and docs < FILE_DOCS and writer.n_ids < FILE_IDS:
                    writer.add(row[0], np.concatenate([np.frombuffer(row[1], "<u4").astype(np.uint64), last]))
                    docs, row = docs + 1, next(rows, None)
                writer.close()
            number += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [docs], "ids": [writer.n_ids]})

    docs = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = [F.col("key"), F.substring("text", 1, PREFIX)]
    tasks = -(-n_bytes // TASK_BYTES)
    # Below the session's number of partitions, adaptive execution finds the number of tasks.
    dealt = docs.repartitionByRange(tasks, *ranges) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else docs.repartitionByRange(*ranges)
    files = dealt.sortWithinPartitions("key", "text").mapInArrow(run, "file string, docs long, ids long").collect()  # a row for each file
    return sorted((r.file, r.docs, r.ids) for r in files)


def read_ids(spark: SparkSession, folder: str, files: list[tuple[str, int, int]], id_col: str = "doc_id") -> DataFrame:
    """id_col, ``start`` among the ids of all files, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every document, one task a file."""
    starts, rows = 0, []
    for name, _, n in files:
        rows.append((name, starts))
        starts += n
    out = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    fields = StructType([StructField(id_col, LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for b in batches:
            for name, first in (rows[i] for i in b.column(0).to_pylist()):
                with fs.open_input_file(f"{path}/{name}") as f:
                    docs = ((k, first + start, len(ids), ids.astype("<u4").tobytes()) for k, start, ids in Reader(f).documents())
                    yield from batched(docs, out)

    return one_task_each(spark, rows).mapInArrow(run, fields)


def checksums(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """read_ids() with ``ids_crc32`` in place of the ids: Spark's crc32 of the same bytes."""
    return df.select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(df: DataFrame, id_col: str, text_col: str, tokenizer: str, kind: str, end_id: int | None) -> DataFrame:
    """Write all documents and read them back."""
    spark = df.sparkSession
    folder = new_folder(spark, "token-ids")
    return checksums(read_ids(spark, folder, write_ids(df, id_col, text_col, tokenizer, kind, end_id, folder), id_col), id_col)


__all__ = ["Reader", "Writer", "checksums", "decode_block", "encode_block", "read_ids", "round_trip", "write_ids"]
