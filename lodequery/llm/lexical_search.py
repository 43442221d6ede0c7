"""Ranked lexical search by windowed bucket scoring.

Index. Every document is read whole once and becomes the postings of the terms that are asked for: (term, occurrences) beside its length. Number and
length of all documents, and each term's documents, are counted from the same rows. They are then sorted into ranges of the document id, equal ids apart
where need be, so that a task holds a run of ids; a document's number is its place there, as ids may be far apart.

Scoring. A task takes its postings in fixed windows of WINDOW numbers. Within a window a document has a slot, and every term a list
of slots, a worth for each, and a set of bits. For each item the terms' worths are added into one array of WINDOW numbers, which stays in the cache;
the bits of its terms, put together, tell which slots are occupied. Those are harvested into the item's heap of the best k, unless they can't reach its least.
A task hands on k rows an item at most, and a window over the items ranks what all tasks found.

Items are taken in blocks of at most BLOCK_TERMS terms (with repeats; a single item may have more), so what is sent to the executors is bounded; each
block is a pass over the documents. A term of no item is never a posting, but counts for the lengths.

Values are integers and exact, but for a term's weight, floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles.

Defined results: a null or empty text has no terms and isn't found; a null id comes after all others of equal score; repeated rows are documents of their
own, ranked next to each other; rows of one item id are one item, whose terms are all of theirs; an item without terms, or without a match, has no rows; an empty table
of either kind gives no rows; very long texts are read whole, a piece at a time. Other columns are never read.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, IntegerType

from lodequery.llm.shared import small_batches, written
from lodequery.llm.terms import as_bytes, term_table, terms

#: Documents of a window, and so slots of the array.
WINDOW = 1 << 13
#: Terms of items that one pass looks for.
BLOCK_TERMS = 1 << 20
SCALE, SHORT, LONG = 1_000_000_000, 25, 75
TABLE = term_table(b"0123456789")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``term`` and ``times``: how often the item has it."""
    small_batches(items.sparkSession)
    kind = items.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(as_bytes(b.column(1))):
                for some in terms(text, TABLE):
                    n = Counter(some)
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(n)), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["item", "term", "times"])

    fields = StructType([StructField("item", kind)]).add("term", "binary").add("times", "long")
    found = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, fields)
    return found.groupBy("item", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc, ``length`` (all its terms), ``found`` and ``tf`` (numbers and occurrences of the vocabulary's terms, in order); documents without terms are left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lengths, found, times, ends = [], [], [], [], [0]
            for i, text in enumerate(as_bytes(b.column(1))):
                n, counts = 0, Counter()
                for some in terms(text, TABLE):
                    n += len(some)
                    counts.update(some)
                if not n:
                    continue
                here = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                at.append(i)
                lengths.append(n)
                found += [t for t, _ in here]
                times += [c for _, c in here]
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], ["doc", "length", "found", "tf"])

    fields = [docs.schema["doc"], StructField("length", LongType()), StructField("found", ArrayType(IntegerType())), StructField("tf", ArrayType(LongType()))]
    return docs.select("doc", "text").mapInArrow(run, StructType(fields))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Best:
    """The k best (score, document) of an item: a heap whose least is the first to go. Documents come in ascending order, so of equals those that came first stay."""

    def __init__(self, k: int):
        self._k, self.heap, self._came = k, [], 0

    def take(self, scores: np.ndarray, docs: np.ndarray) -> None:
        least = self.heap[0][0] if len(self.heap) == self._k else 0
        near = np.flatnonzero(scores > least)
        if len(near) > self._k:  # a stable order: of equal scores the first documents
            near = np.sort(near[np.argsort(-scores[near], kind="stable")[: self._k]])
        for i in near.tolist():
            self._came += 1
            entry = (int(scores[i]), -self._came, docs[i])
            if len(self.heap) < self._k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def score_window(docs: np.ndarray, m: np.ndarray, rows: np.ndarray, found: np.ndarray, tf: np.ndarray, weights: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> None:
    """Adds a window's documents to the heaps. rows: the slot of each posting; items: numbers of their terms, and how often."""
    order = np.argsort(found, kind="stable")
    found, slots, tf = found[order], rows[order], tf[order]
    worth = SCALE * tf // (1000 * tf + 8 * m[slots])
    there, starts = np.unique(found, return_index=True)
    ends = np.append(starts[1:], len(found))
    bits = np.zeros((len(there), -(-len(docs) // 64)), np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(there)), ends - starts), slots >> 6), np.uint64(1) << (slots & 63).astype(np.uint64))
    bucket = np.zeros(len(docs), np.int64)
    for (numbers, times), heap in zip(items, best, strict=True):
        at = np.searchsorted(there, numbers)
        met = np.flatnonzero((at < len(there)) & (there[np.minimum(at, len(there) - 1)] == numbers)) if len(there) else ()
        if not len(met):
            continue
        for i in met.tolist():
            a, z = starts[at[i]], ends[at[i]]
            bucket[slots[a:z]] += weights[numbers[i]] * times[i] * worth[a:z]
        occupied = np.bitwise_or.reduce(bits[at[met]], axis=0)
        slot = np.flatnonzero(np.unpackbits(occupied.view(np.uint8), bitorder="little"))
        heap.take(bucket[slot], docs[slot])
        bucket[slot] = 0


def _ranked_block(index: DataFrame, weights: np.ndarray, items: list[tuple], k: int, kind) -> DataFrame:
    """item, doc and score: of each task the k best documents of each item."""
    id_type, asked = index.schema["doc"], [(n, t) for _, n, t in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, types, held = [Best(k) for _ in items], None, []

        def scored(window: pa.Table) -> None:
            part = window.combine_chunks()
            ids = np.empty(part.num_rows, object)
            ids[:] = part["doc"].to_pylist()
            sizes = part["found"].combine_chunks().value_lengths().to_numpy()
            flat = [part[c].combine_chunks().flatten().to_numpy() for c in ("found", "tf")]
            score_window(ids, part["m"].to_numpy(), np.repeat(np.arange(len(ids)), sizes), *flat, weights, asked, best)

        for b in batches:
            types = types or b.schema
            held.append(b)
            while sum(h.num_rows for h in held) >= WINDOW:
                rows = pa.Table.from_batches(held)
                scored(rows.slice(0, WINDOW))
                held = rows.slice(WINDOW).to_batches()
        if held:
            scored(pa.Table.from_batches(held))
        rows = [(i, doc, score) for (i, _, _), heap in zip(items, best, strict=True) for score, _, doc in heap.heap]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, kind[1]), pa.array(doc, types.field("doc").type), pa.array(score, pa.int64())], ["item", "doc", "score"])

    return index.mapInArrow(run, StructType([StructField("item", kind[0]), id_type, StructField("score", LongType())]))


def search(docs: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, item_text_col: str, k: int = 10) -> DataFrame:
    """item_col, ``rank`` (from 1), doc_col and ``score``: the k best documents of each item, of those with a score above zero; ties go to the smaller id.

    doc_col holds integers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(f"`{doc_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    wanted = written(item_terms(items, item_col, item_text_col), "asked")
    of_item = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # Items in blocks by a running number of terms, which one pass each can hold.
    total = of_item.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).orderBy("item", "term").toArrow() if blocks > 1 else wanted.orderBy("item", "term").toArrow()
        part = _block(docs, rows, k, items.schema[item_col].dataType)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.select("item", F.row_number().over(best).alias("rank"), "doc", "score").filter(F.col("rank") <= k)
    return ranked.toDF(item_col, "rank", doc_col, "score")


def _block(docs: DataFrame, asked: pa.Table, k: int, item_type) -> DataFrame:
    """item, doc and score of the tasks' best documents for a block of items."""
    vocabulary = {t: i for i, t in enumerate(sorted(set(asked["term"].to_pylist())))}
    index = written(postings(docs, vocabulary), "postings")
    n, length = index.agg(F.count(F.lit(1)), F.sum("length")).first()
    length = length or 1  # without a document there is nothing to score
    in_docs = dict(index.select(F.explode("found").alias("t")).groupBy("t").count().collect())  # a row a term of the vocabulary
    weights = np.array([weight(n, in_docs.get(i, n)) for i in range(len(vocabulary))], np.int64)
    items, last = [], object()
    for item, term, times in zip(*(asked[c].to_pylist() for c in ("item", "term", "times")), strict=True):
        if item != last:
            items.append((item, [], []))
            last = item
        items[-1][1].append(vocabulary[term])
        items[-1][2].append(times)
    items = [(i, np.array(t, np.int64), np.array(c, np.int64)) for i, t, c in items]
    m = F.expr(f"{100 - LONG}L + ({LONG} * CAST(length AS DECIMAL(20, 0)) * {n}) div {length}")
    placed = index.select("doc", m.alias("m"), "found", "tf").withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))
    # By id, and rows of one id by turns: one id, however often it is there, is not one task.
    apart = placed.repartitionByRange(F.col("doc").asc_nulls_last(), "turn").sortWithinPartitions(F.col("doc").asc_nulls_last()).drop("turn")
    return _ranked_block(apart, weights, items, k, (item_type, asked.schema.field("item").type))
