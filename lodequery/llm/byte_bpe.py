"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Encoding. Texts longer than SPLIT_AT are cut at safe boundaries first, where no match of the
pattern can cross: before white space that follows a character which isn't. A white-space run of LONGEST_RUN
characters or more never goes through the pattern, whose backtracking it would exhaust: what the pattern makes of it is known. It is one
match, less its last character if something follows it, and goes to the merges as it is. So the ids are those of the whole text.
Decoding joins the tokens' raw bytes; bytes of one character may be spread over several tokens.

Defined results: a null text encodes like an empty one (no ids); special-token strings in a text are
ordinary text; repeated rows are encoded each; an empty table gives an empty table. Only the two
columns named are read, so other columns can't clash. A very long text is encoded whole, a row at a time; one without
white space (many scripts, encoded data) isn't cut at all and goes to the library in one piece, which takes linear time.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, BinaryType, LongType, StringType

from lodequery.llm.shared import batched, rows_of, small_batches

SPLIT_AT = 1 << 16
LONGEST_RUN = 1 << 12
PATTERN = public_tokenizers.PATTERN
#: Fixed value: white space as the pattern's engine has it (Unicode's, without Python's U+001C to U+001F).
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = re.compile(f"(?<![{SPACE}])[{SPACE}]")
_RUN = re.compile(f"[{SPACE}]{{{LONGEST_RUN},}}+")


def split_safely(text: str, limit: int = SPLIT_AT) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match) whose encodings, one after the other, are the encoding of the text."""
    at = 0
    for run in _RUN.finditer(text) if len(text) >= LONGEST_RUN else ():
        yield from _split(text, at, run.start(), limit)
        at = run.end() - (run.end() < len(text))  # the last character is the next match's
        yield text[run.start() : at], True
    yield from _split(text, at, len(text), limit)


def _split(text: str, at: int, end: int, limit: int) -> Iterator[tuple[str, bool]]:
    while end - at > limit:
        m = _EDGE.search(text, at + limit // 2, end)
        if m is None:
            break
        yield text[at : m.start()], False
        at = m.start()
    if at < end:
        yield text[at:end], False


def encoded(engine: tiktoken.Encoding, text: str | None) -> Iterator[list[int]]:
    """The ids of a text, part by part, without special tokens."""
    for part, one in split_safely(text or ""):
        yield engine._encode_single_piece(part) if one else engine.encode_ordinary(part)


class Codec:
    """The encoding of a rank file and a pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in encoded(self._encoding, text) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return self._encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for a worker process and rank file. The file must be at the same path on every executor."""
    return Codec(ranks_path, pattern)


def encode_texts(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """id_col, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every text; a narrow step, without a shuffle."""
    small_batches(df.sparkSession)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, out = codec(ranks_path, pattern), None
        for b in batches:
            out = out or pa.schema([(id_col, b.schema.field(0).type), ("n_tokens", pa.int64()), ("ids", pa.binary())])
            encoded = ((k, c.encode(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield from batched(((k, len(i), np.array(i, "<u4").tobytes()) for k, i in encoded), out)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(df: DataFrame, id_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of encode_texts() with ``decoded``, the raw bytes of the ids, and ``ids_sha256``, of the decimal ids joined by a space."""
    small_batches(df.sparkSession)
    fields = [*(StructField(c, df.schema[c].dataType) for c in (id_col, "n_tokens")), StructField("ids_sha256", StringType()), StructField("decoded", BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, out = codec(ranks_path, pattern), None
        for b in batches:
            out = out or pa.schema([(id_col, b.schema.field(0).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded", pa.binary())])
            yield from batched(map(row, rows_of([b], id_col, "n_tokens", "ids"), [c] * b.num_rows), out)

    def row(r: tuple, c: Codec) -> tuple:
        ids = np.frombuffer(r[2], "<u4").tolist()
        return r[0], r[1], hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), c.decode(ids)

    return df.select(id_col, "n_tokens", "ids").mapInArrow(run, StructType(fields))
