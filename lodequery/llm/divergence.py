"""How far the sources of a language differ in their use of terms: a baseline-correction inverted index.

Every (language, source) group gives each of the language's V kept terms a share p of a thousand million, smoothed, so that terms without occurrences
have one, too: p0. The difference of two sources is the sum of |p - q| over all V terms. It starts at V times |p0 - q0|, as if neither had
any term. Then the postings of a term (the sources that have it, with their p) correct it: only for pairs of which at least one has the
term, and only where the correction isn't zero. So work follows the postings instead of V times all pairs.

Counting. A task counts terms of each group in dictionaries, which it hands on before they grow beyond HELD entries, so that of a hot source or term
one row a task is shuffled. Corrections. The sources of a language are numbered and cut into blocks of BLOCK, its terms into slices of about SLICE. A task takes the
postings of one slice for one pair of blocks, adds up corrections in a square of BLOCK by BLOCK numbers, and hands on what isn't zero. What grows with the
square of the sources is the result alone. The terms that set a source apart are ranked by a window, which cuts off before its shuffle.

Arithmetic is exact: products that could pass 64 bits are decimals, all values that are left fit.

Defined results: null texts, languages and sources are read as ''; empty texts have no terms, but their group takes part; ties go by the item's bytes; repeated rows
count each, as documents of their own; very long texts are counted whole, a piece at a time; an empty table gives no rows; a language of one source has no pairs, and one
without kept terms has pairs with value 0. Other columns are never read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.llm.shared import small_batches, written
from lodequery.llm.terms import as_bytes, term_table, terms

WHOLE, SMOOTH = 1_000_000_000, 5
#: Entries of a task's dictionaries before they are handed on.
HELD = 400_000
#: Sources of a block, and terms of a slice.
BLOCK, SLICE = 512, 1024


def term_counts(df: DataFrame) -> DataFrame:
    """lang, source, term, ``n`` (occurrences) and ``docs`` (rows that have it), from lang, source and text, none null; added up by task."""
    small_batches(df.sparkSession)
    table = term_table()
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def handed_on(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            found = list(n)
            for a in range(0, len(found), 1 << 16):
                part = found[a : a + (1 << 16)]
                columns = [[lang] * len(part), [source] * len(part), part, [n[t] for t in part], [docs[t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size, seen = size - len(n), set()
                for some in terms(text, table):
                    n.update(some)
                    seen.update(some)
                docs.update(seen)
                size += len(n)
                if size > HELD:
                    yield from handed_on(held)
                    held, size = {}, 0
        yield from handed_on(held)

    found = df.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: Column | str, v: Column | str) -> Column:
    """1 + floor(WHOLE * (n + SMOOTH) / (total + SMOOTH * v)); 0 where v is 0."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + ({WHOLE} * (CAST({n} AS DECIMAL(20, 0)) + {SMOOTH})) div (CAST({total} AS DECIMAL(20, 0)) + {SMOOTH} * {v}) ELSE 0L END")


def _corrections(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, ``i``, ``j`` (numbers of sources, i < j) and ``change``: the sums of the corrections that aren't zero, by slice."""
    small_batches(postings.sparkSession)
    several = groups.select("lang", "number", "base", "blocks", F.expr(f"CAST(CEIL(v / {SLICE}) AS INT)").alias("slices"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    several = several.withColumn("own", F.expr(f"CAST(number div {BLOCK} AS INT)"))
    key = ["lang", "a", "b", "slice"]
    pair = [F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")]
    bases = several.filter("slices > 0").select("lang", *pair, F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"), F.lit(None).cast("binary").alias("term"), "number", F.col("base").alias("p"))
    placed = postings.join(groups.select("lang", "source", "number", "blocks", "v"), ["lang", "source"])
    placed = placed.select("lang", "term", "number", "p", F.expr(f"CAST(number div {BLOCK} AS INT)").alias("own"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"), F.expr(f"CAST(pmod(xxhash64(term), CEIL(v / {SLICE})) AS INT)").alias("slice"))
    rows = placed.select("lang", *pair, "slice", "term", "number", "p").unionByName(bases)
    # Bases come first in their slice, then the postings, those of a term together.
    together = rows.repartition(*key).sortWithinPartitions(*key, F.col("term").asc_nulls_first(), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, square = None, None
        for b in batches:
            number, p = (b.column(c).to_numpy() for c in ("number", "p"))
            keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
            found = as_bytes(b.column("term"))
            cuts = [0, *(i for i in range(1, len(keys)) if found[i] != found[i - 1] or keys[i] != keys[i - 1]), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if keys[x] != now:
                    if now is not None:
                        yield square.changes(now[0])
                    now, square = keys[x], _Square(keys[x][1], keys[x][2])
                square.take(found[x], number[x:y], p[x:y])
        if now is not None:
            yield square.changes(now[0])

    return together.mapInArrow(run, "lang string, i int, j int, change long")


class _Square:
    """Corrections between the sources of two blocks (or of one) from the postings of terms, which come one term after the other."""

    def __init__(self, a: int, b: int):
        self._ends = (a * BLOCK, b * BLOCK)
        self._base = np.zeros((1 if a == b else 2) * BLOCK, np.int64)
        self._size = np.zeros(2, np.int64)
        self._sum, self._term, self._held = None, None, []

    def _place(self, number: np.ndarray) -> np.ndarray:
        a, b = self._ends
        return np.where(number // BLOCK * BLOCK == a, number - a, number - b + BLOCK if b != a else 0)

    def take(self, term: bytes | None, number: np.ndarray, p: np.ndarray) -> None:
        at = self._place(number.astype(np.int64))
        if term is None:
            self._base[at] = p
            self._last = max(int(at.max()), getattr(self, "_last", 0))
            return
        if self._sum is None:
            self._base = self._base[: self._last + 1]
            self._far = np.abs(self._base[:, None] - self._base)
            self._sum = np.zeros_like(self._far)
        if term != self._term:
            self._correct()
            self._term = term
        self._held.append((at, p))

    def _correct(self) -> None:
        """Adds |p - q| less the baseline for each pair of which one has the term."""
        if not self._held:
            return
        at, p = (np.concatenate(x) for x in zip(*self._held, strict=True))
        self._held = []
        now = self._base.copy()
        now[at] = p
        change = np.abs(p[:, None] - now) - self._far[at]
        self._sum[at] += change
        rest = np.ones(len(now), bool)
        rest[at] = False
        self._sum[np.ix_(rest, at)] += change[:, rest].T

    def changes(self, lang: str) -> pa.RecordBatch:
        found = np.zeros((3, 0), np.int64)
        if self._sum is not None:
            self._correct()
            a, b = self._ends
            i, j = np.nonzero(np.triu(self._sum, 1))
            if a != b:  # pairs within a block are another task's
                across = (i < BLOCK) & (j >= BLOCK)
                i, j = i[across], j[across]
            found = np.stack([i + a, j + a if a == b else j - BLOCK + b, self._sum[i, j]])
        types = (pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([lang] * found.shape[1], pa.string()), *(pa.array(c).cast(t) for c, t in zip(found, types, strict=True))], ["lang", "i", "j", "change"])


def audit(df: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, ``part``, ``item``, ``value`` and ``rank``.

    Part pair: the other sources of the language (item) by how far they are from this one, all of them. Part term: the kept terms that this source has and
    gives a greater share than the language does, by the difference, ``top`` at most. Kept are terms in ``least_docs`` rows of their language or more.
    """
    docs = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    of_term = Window.partitionBy("lang", "term")
    counts = written(term_counts(docs), "counts")
    kept = counts.withColumns({"in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")}).filter(F.col("in_docs") >= least_docs)
    kept = written(kept.select("lang", "source", "term", "n", "lang_n", "first"), "kept")
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "total", F.sum("total").over(of_lang).alias("lang_total"), F.sum("firsts").over(of_lang).alias("v"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("number"), F.count(F.lit(1)).over(of_lang).alias("sources"))
    groups = groups.select("*", share("0", "total", "v").alias("base"), F.expr(f"CAST(CEIL(sources / {BLOCK}) AS INT)").alias("blocks"))
    groups = written(groups, "groups")

    postings = kept.join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
    postings = postings.select("lang", "source", "term", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q"))
    changes = _corrections(postings, groups).groupBy("lang", "i", "j").agg(F.sum("change").alias("change"))

    one = groups.select("lang", "source", "number", "base", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("base").alias("other_base"))
    pairs = one.join(other, "lang").filter("number != other").withColumns({"i": F.least("number", "other"), "j": F.greatest("number", "other")})
    pairs = pairs.join(changes, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("v * abs(base - other_base) + coalesce(change, 0L)").alias("value"))
    apart = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr("p - q").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(ranked).alias("rank")
    return pairs.select("*", rank).unionByName(apart.select("*", rank).filter(F.col("rank") <= top))
