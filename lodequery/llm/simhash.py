"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints. A fingerprint bit is set if it is in more than half of the hashes (XXH64) of a document's shingles.

Covering tables. Every bit position i has a nonzero vector f(i) of radius + 1 bits, and there is a table for each
nonzero vector v of radius + 1 bits whose mask has the positions with an odd inner product <f(i), v>. The f(i) of any
radius positions span less than the whole space, so some v is orthogonal to all of them, and in its table two
fingerprints that differ in at most these positions have the same masked value: no pair within the radius is missed.

Links. Equal fingerprints are one node, whatever their number. Nodes that meet in a bucket are compared by the
exact number of differing bits. A bucket of more than CHUNK nodes is dealt to several tasks, by pairs of chunks, so
that no task holds more than two chunks of one. Of the links in a group only those that join two of its parts so far leave
the task, at most one for each node; components are the same as from all links.

Defined results: null and empty texts have fingerprint zero, which links like any other; null document ids never name a component
unless there is no other in it (then null); repeated rows are kept; very long texts are taken whole, their shingles counted _AT_ONCE at a time; other columns are never read by near_duplicates() and come
through drop_near_copies() unchanged, whatever their names; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodequery.llm.components import components
from lodequery.llm.shared import small_batches, written

SEED = 42
CHUNK = 2048
#: Shingles whose bits are counted at once: bounds memory on very long texts.
_AT_ONCE = 1 << 14


def words(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingles(found: list[bytes], k: int) -> list[bytes]:
    """k words each, repeats included; the whole sequence if there are fewer."""
    if len(found) <= k:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(k)), strict=False)))


def hashes(items: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in items), np.uint64, len(items))


def majority(h: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes as an unsigned number; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), _AT_ONCE):
        ones += np.unpackbits(h[a : a + _AT_ONCE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int, width: int = 64) -> list[int]:
    """The covering tables' masks over the low ``width`` bits."""
    top = (1 << (radius + 1)) - 1
    vector = [i % top + 1 for i in range(width)]
    return [sum(1 << i for i, f in enumerate(vector) if (f & v).bit_count() & 1) for v in range(1, top + 1)]


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id_col and ``fp``, the signed 64-bit fingerprint of the text's k-word shingles."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(majority(hashes(shingles(words(t), k)))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, StructType([df.schema[id_col], StructField("fp", LongType())]))


def table_rows(nodes: DataFrame, lanes: list, radius: int, width: int = 64) -> DataFrame:
    """``node`` with ``t`` and ``key`` for each table of each lane (a long column)."""
    found = masks(radius, width)
    rows = [F.struct(F.lit(i * len(found) + j).alias("t"), lane.bitwiseAND(F.lit(signed(m))).alias("key")) for i, lane in enumerate(lanes) for j, m in enumerate(found)]
    return nodes.select("node", F.explode(F.array(*rows)).alias("_row")).select("node", "_row.t", "_row.key")


def links(rows: DataFrame, prints: DataFrame, fp: list[str], most: int, chunk: int = CHUNK, nearest_first: tuple[int, ...] = ()) -> DataFrame:
    """Edges ``a``, ``b`` between nodes of one bucket (t, key) whose fingerprints differ in at most ``most`` bits.

    rows: node, t and key; prints: each node's fingerprint in long columns fp, read only for nodes that share a bucket.
    Not all edges, but enough for the same components within each bucket; those within lower limits nearest_first go before others.
    """
    small_batches(rows.sparkSession)
    shared = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = (
        rows.join(shared, ["t", "key"])
        .withColumn("k", F.ceil(F.col("n") / chunk).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("group", F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")))
        .select("group", "node")
        .join(prints.select("node", *fp), "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            rows = _arrays(b, fp)
            rows = rows if left is None else [np.concatenate(p) for p in zip(left, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            yield _linked([r[:cut] for r in rows], (*nearest_first, most))
            left = [r[cut:] for r in rows]
        if left is not None:
            yield _linked(left, (*nearest_first, most))

    together = dealt.repartition("group").sortWithinPartitions("group", "node")
    return together.mapInArrow(run, "a long, b long")


def _arrays(b: pa.RecordBatch, fp: list[str]) -> list[np.ndarray]:
    bits = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in fp], axis=1)
    return [b.column("group").to_numpy(zero_copy_only=False), b.column("node").to_numpy(zero_copy_only=False), bits]


def _linked(rows: list[np.ndarray], limits: tuple[int, ...]) -> pa.RecordBatch:
    """A forest of the links within each run of equal groups; rows are in the order of groups."""
    group, node, bits = rows
    parent = np.arange(len(group))
    starts = _starts(group)
    times = np.diff(np.r_[starts, len(group)])
    a_out, b_out = [], []
    for limit in limits:
        here = _still_apart(np.arange(len(group)), parent, starts, times)
        shift = 0
        while True:
            shift += 1
            here = here[here + shift < len(group)]
            here = here[group[here] == group[here + shift]]
            if not len(here):
                break
            a, b = here, here + shift
            apart = parent[a] != parent[b]
            a, b = a[apart], b[apart]
            near = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= limit
            merged = False
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                p, q = _root(parent, x), _root(parent, y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a_out.append(x)
                    b_out.append(y)
                    merged = True
            while merged and (parent != parent[parent]).any():
                parent = parent[parent]
            if merged:
                here = _still_apart(here, parent, starts, times)
    return pa.RecordBatch.from_arrays([pa.array(node[a_out] if a_out else [], pa.int64()), pa.array(node[b_out] if b_out else [], pa.int64())], ["a", "b"])


def _starts(group: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)


def _still_apart(here: np.ndarray, parent: np.ndarray, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Those of the places here whose run has more than one parent: the others have no links to find."""
    if not len(here):
        return here
    return here[np.repeat(np.minimum.reduceat(parent, starts) != np.maximum.reduceat(parent, starts), times)[here]]


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        x = parent[x]
    return int(x)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, k: int = 3, radius: int = 2) -> DataFrame:
    """id_col, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id that is reachable over links of at most ``radius`` bits."""
    found = written(fingerprints(df, id_col, text_col, k), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min(id_col).alias("least"))
    prints = nodes.select(F.col("fp").alias("node"), "fp")
    edges = links(table_rows(prints, [F.col("fp")], radius), prints, ["fp"], radius)
    part = components(edges)
    of = written(nodes.join(part, nodes.fp == part.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "classes")
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.join(of.join(named, "component").select("fp", "component_id"), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies at a similarity of shingle sets, in two passes. At a Jaccard similarity of 0.8 fingerprints of 64 bits differ in ten,
# which no small number of tables covers. So SimHash is a first pass: its tables are made of lanes of a second fingerprint, that of the set of
# words, which a few changed words leave nearly whole, and fingerprints of the shingles, of WIDE * 64 bits, choose the links to look at. A second
# pass finds every pair that the first one left apart (see _prefixes). What counts in both is the similarity of the shingle sets themselves.
LANES, LANE_BITS, LANE_RADIUS, WIDE = 8, 40, 2, 8
#: Texts, and shingles of each, that tell which shingles are common: the order of shingles, never the result, depends on them.
SAMPLE_TEXTS, SAMPLE_SHINGLES = 20_000, 1_000
#: Nodes that share a shingle of their prefixes beyond which their pairs are looked at by parity bits, of which there are so many.
CROWD, BITS = 32, 512
#: Pairs of one node that are compared where its text is.
HUB_PAIRS = 256
#: Pairs held before those of equal nodes are added up.
_PAIRS_AT_ONCE = 1 << 18


def differing_bits(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits that fingerprints of sets with this Jaccard similarity differ in on average, and a standard deviation more."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + np.sqrt(bits * p * (1 - p)))


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """n unsigned 64-bit hashes of each hash (the splitmix64 finaliser over an arithmetic sequence)."""
    x = h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_majority(h: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of 64 n bits of a set of hashes, as bits."""
    ones = np.zeros(64 * n, np.int64)
    for a in range(0, len(h), 255):  # as many ones as a byte can count
        ones += np.unpackbits(_spread(h[a : a + 255], n).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(h)


def _longs(bits: np.ndarray, width: int = 64) -> list[int]:
    rows = bits.reshape(-1, width)
    return np.packbits(np.pad(rows, ((0, 0), (64 - width, 0))), axis=1).view(">i8").ravel().tolist()


def _set_of(text: str | None, k: int) -> np.ndarray:
    """The sorted hashes of the set of shingles."""
    return np.unique(hashes(shingles(words(text), k)))


def _common(texts: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of shingles that more than one distinct text of a sample has, and the numbers of texts."""
    n = texts.count()
    some = texts.select(text_col)
    if n > SAMPLE_TEXTS:
        some = some.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < (SAMPLE_TEXTS << 20) // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, found = set(), [np.zeros(0, np.uint64)]
        for b in batches:
            for t in b.column(0).to_pylist():
                if t not in seen:
                    seen.add(t)
                    found.append(np.unique(hashes(shingles(words(t)[: SAMPLE_SHINGLES + k - 1], k))))
        h, times = np.unique(np.concatenate(found), return_counts=True)
        h, times = h[times > 1], times[times > 1]
        yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()]), pa.array([times.astype(np.int64).tobytes()])], ["h", "times"])

    got = some.distinct().repartition(1).mapInArrow(run, "h binary, times binary").collect()
    h, times = (b"".join(bytes(r[c]) for r in got) for c in ("h", "times"))
    return np.frombuffer(h, np.uint64), np.frombuffer(times, np.int64)


def _prefixes(texts: DataFrame, text_col: str, k: int, limit: Fraction) -> DataFrame:
    """``_uid``, ``size`` of the text's shingle set, ``prefix``: its rarest shingles, and ``parity``: BITS bits, each the parity of the shingles that fall on it.

    Shingles are put into one order, rare ones first (by the sample, then by hash). Two sets of n and m shingles and a similarity of t or more
    share at least t / (1 + t) * (n + m). So they can't do without a common one among the first n - ceil(t n) + 1 of the one and the first
    m - ceil(t m) + 1 of the other: pairs that meet in no prefix are below t, and no pair at t or above is missed.
    """
    known, times = _common(texts, text_col, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found, parity = [], [], []
            for t in b.column(1).to_pylist():
                h = _set_of(t, k)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                often = np.where(known[at] == h, times[at], 0) if len(known) else np.zeros(len(h), np.int64)
                sizes.append(len(h))
                found.append(h[np.lexsort((h, often))[: _first(len(h), limit)]].view(np.int64))
                parity.append(np.packbits(np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) % 2 == 1).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(parity, pa.binary())], ["_uid", "size", "prefix", "parity"])

    return texts.select("_uid", text_col).mapInArrow(run, "_uid long, size long, prefix array<long>, parity binary")


def _first(n, limit: Fraction):
    """Shingles in the prefix of a set of n."""
    return n - -(-limit.numerator * n // limit.denominator) + (n > 0)


def _pairs(prefixes: DataFrame, part: DataFrame, limit: Fraction) -> DataFrame:
    """Pairs a, b of nodes that may have at least this similarity; part: node and component of those that have links so far.

    Left out, as below the limit for sure: sizes too far apart, and fewer common shingles in the prefixes than make up for all of the
    shingles behind one of them. Nodes of one component need no pair. Where more than CROWD nodes share a shingle, their pairs are left to _crowded.
    """
    p, q = limit.numerator, limit.denominator

    def met(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shingle, node, component, size = rows
        starts = _starts(shingle)
        times = np.diff(np.r_[starts, len(shingle)])
        crowded = np.repeat(times > CROWD, times)
        if crowded.any():
            c = [x[crowded] for x in (node, shingle, component)]
            yield batch([*c, np.zeros(len(c[0]), np.int64)])
        here, shift, held = np.flatnonzero(~crowded), 0, []
        while len(here):
            shift += 1
            here = here[here + shift < len(node)]
            # In order of size within a shingle: who is too small for one is too small for all that follow.
            here = here[(shingle[here] == shingle[here + shift]) & (q * size[here] >= p * size[here + shift])]
            x, y = here, here + shift
            apart = component[x] != component[y]
            x, y = x[apart], y[apart]
            need = -(-p * (size[x] + size[y]) // (p + q)) - np.maximum(size[x] - _first(size[x], limit), size[y] - _first(size[y], limit))
            held.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), need], axis=1))
            if sum(map(len, held)) > _PAIRS_AT_ONCE:
                yield summed(held)
                held = []
        if held:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        abn, n = np.unique(np.concatenate(held), axis=0, return_counts=True)
        return batch([*abn.T, n])

    def batch(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "need", "n"])

    # A node alone is its own component, named only after the shuffle.
    rows = prefixes.join(part, "node", "left").select(F.explode("prefix").alias("shingle"), "node", "component", "size")
    together = rows.repartition("shingle").sortWithinPartitions("shingle", "size", "node").select("shingle", "node", F.coalesce("component", "node").alias("component"), "size")
    found = written(together.mapInArrow(_by_group(met), "a long, b long, need long, n long"), "met")
    few = found.filter("n > 0").groupBy("a", "b", "need").agg(F.sum("n").alias("n")).filter("n >= need").select("a", "b")
    # Members of crowds: node, shingle and component stand in a, b and need.
    crowds = found.filter("n = 0").select(F.col("a").alias("node"), F.col("b").alias("shingle"), F.col("need").alias("component"))
    return few.unionByName(_crowded(crowds, prefixes, limit))


def dealt_crowds(crowds: DataFrame, chunk: int) -> DataFrame:
    """``group``, node, component and ``side`` of the members (node, shingle, component) of crowds, by pairs of chunks of about ``chunk`` nodes.

    Any two members of a crowd meet in one group: of sides 0 and 1, or both of side 2. No group has more than about two chunks, whatever the crowd's size.
    """
    n = crowds.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    own = crowds.join(n, "shingle").withColumn("k", F.ceil(F.col("n") / chunk).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("k")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")).cast("long")
    return each.select(F.xxhash64("shingle", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), "node", "component", side.alias("side"))


def _crowded(crowds: DataFrame, prefixes: DataFrame, limit: Fraction) -> DataFrame:
    """Pairs a, b of nodes of different components that share a shingle, as far as their parity bits allow for this similarity.

    Sets of n and m shingles at a similarity of t or more differ in (1 - t) / (1 + t) * (n + m) shingles at most, and their parity bits in no more bits.
    """
    p, q = limit.numerator, limit.denominator

    def met(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        group, node, component, side, size, bits = rows
        held = [np.zeros((0, 2), np.int64)]
        for x, y in _across(group, component, size, limit):
            apart = (side[x] != side[y]) | (side[x] == 2)
            x, y = x[apart], y[apart]
            near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) * (p + q) <= (q - p) * (size[x] + size[y])
            x, y = x[near], y[near]
            held.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1))
        ab = np.unique(np.concatenate(held), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ab.T], ["a", "b"])

    # A crowd of one component has no such pairs.
    mixed = crowds.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most").select("shingle")
    rows = dealt_crowds(crowds.join(mixed, "shingle", "left_semi"), CHUNK).join(prefixes.select("node", "size", "parity"), "node")
    together = rows.repartition("group").sortWithinPartitions("group", "size", "node").select("group", "node", "component", "side", "size", "parity")
    return together.mapInArrow(_by_group(met), "a long, b long")


def _across(group: np.ndarray, component: np.ndarray, size: np.ndarray, limit: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x < y of the pairs of one group and different components whose sizes allow for this similarity, each once; rows are in the order of group and size.

    Where one component has half of a group or more, only pairs with members of the others are looked at: copies that are joined cost no square of their number.
    """
    p, q = limit.numerator, limit.denominator
    starts, mixed = _starts(group), np.zeros(len(group), bool)
    for a, b in zip(starts.tolist(), np.r_[starts, len(group)][1:].tolist(), strict=True):
        _, of, times = np.unique(component[a:b], return_inverse=True, return_counts=True)
        if len(times) < 2:
            continue
        largest = of == times.argmax()
        few = np.flatnonzero(~largest)
        if 2 * len(few) > b - a:
            mixed[a:b] = True
            continue
        sizes = size[a:b]
        low, high = np.searchsorted(sizes, -(-p * sizes[few] // q)), np.searchsorted(sizes, q * sizes[few] // p, "right")
        for i, lo, hi in zip(few.tolist(), low.tolist(), high.tolist(), strict=True):
            j = np.arange(lo, hi)
            j = j[(of[lo:hi] != of[i]) & (largest[lo:hi] | (j > i))]
            yield a + np.minimum(i, j), a + np.maximum(i, j)
    here, shift = np.flatnonzero(mixed), 0
    while len(here):
        shift += 1
        here = here[here + shift < len(group)]
        here = here[(group[here] == group[here + shift]) & (q * size[here] >= p * size[here + shift])]
        apart = component[here] != component[here + shift]
        yield here[apart], here[apart] + shift


def _by_group(each):
    """Runs ``each`` over columns of rows, as arrays, that hold all rows of each value of the first column, which is sorted."""

    def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, BITS // 64) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, n = [], 0
        for b in batches:
            rows = arrays(b)
            if not b.num_rows:
                continue
            if left and rows[0][0] == left[0][0][0] and rows[0][-1] == rows[0][0]:  # all of the group that goes on
                left.append(rows)
                continue
            rows = [np.concatenate(x) for x in zip(*left, rows, strict=True)] if left else rows
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from each([r[:cut] for r in rows])
            left = [[r[cut:] for r in rows]]
        if left:
            yield from each([np.concatenate(x) for x in zip(*left, strict=True)])

    return run


def _with_hubs(prefixes: DataFrame, found: DataFrame, limit: Fraction) -> DataFrame:
    """Pairs a, b of a node and the one of most links so far, of more than one, that has a shingle of its prefix.

    Copies of one text may be near to it and not to each other. These pairs, one for each shingle of a prefix at most, join such groups
    before _pairs looks at all pairs of different components.
    """
    p, q = limit.numerator, limit.denominator
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree")).filter("degree > 1")
    each = prefixes.select("node", "size", F.explode("prefix").alias("shingle"))
    hubs = prefixes.join(ends, "node").select(F.explode("prefix").alias("shingle"), F.struct("degree", "node", "size").alias("hub"))
    hubs = written(hubs.groupBy("shingle").agg(F.max("hub").alias("hub")).select("shingle", F.col("hub.node").alias("hub"), F.col("hub.size").alias("of")), "hubs")
    met = each.join(hubs, "shingle").filter(f"node != hub and least(size, of) * {q} >= greatest(size, of) * {p}")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct().join(found, ["a", "b"], "left_anti")


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, text_col: str, k: int, limit: Fraction) -> DataFrame:
    """Those of the pairs a, b whose shingle sets have at least this Jaccard similarity.

    Only texts of nodes in pairs are moved. The node of a pair that is in more pairs stays where its text is, with up to about HUB_PAIRS of
    its pairs to a group, and the other's text comes to it: a text that is in many pairs travels, and is cut into shingles, once a group, not once a pair.
    (Texts take less room than the hashes of their shingles, which don't compress.) Sets are compared as sorted hashes of 64 bits.
    """
    pairs = written(pairs.distinct(), "pairs")
    degrees = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    wanted = degrees.join(nodes, "node").select("node", F.col("best.uid").alias("_uid"))
    moved = written(texts.select("_uid", F.col(f"`{text_col}`").alias("t")).join(wanted, "_uid").select("node", "t"), "texts")
    of_a, of_b = (degrees.select(F.col("node").alias(c), F.col("degree").alias(f"d{c}")) for c in "ab")
    hub = F.col("da") > F.col("db")
    placed = pairs.join(of_a, "a").join(of_b, "b").select(F.when(hub, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("da", "db").alias("n"))
    placed = written(placed.select("hub", F.pmod(F.xxhash64("other", F.lit(SEED)), F.ceil(F.col("n") / HUB_PAIRS)).cast("int").alias("part"), "other"), "placed")
    others = placed.join(moved.withColumnRenamed("node", "other"), "other").select("hub", "part", "other", "t")
    hubs = placed.select("hub", "part").distinct().join(moved.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("other"), "t")
    # A group's hub comes first.
    together = others.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("other").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for b in batches:
            a_out, b_out = [], []
            for here, other, t in zip(*(b.column(c).to_pylist() for c in ("hub", "other", "t")), strict=True):
                theirs = _set_of(t, k)
                if other is None:
                    mine = theirs
                    continue
                both = _common_of(mine, theirs)
                if both * limit.denominator >= limit.numerator * (len(mine) + len(theirs) - both):
                    a_out.append(min(here, other))
                    b_out.append(max(here, other))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def _common_of(s: np.ndarray, t: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    if not len(s):
        return 0
    at = np.searchsorted(t, s)
    return int((t[np.minimum(at, len(t) - 1)] == s).sum())


def drop_near_copies(df: DataFrame, id_col: str, text_col: str, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df with one row of each group of near copies: that with the smallest id, of equal ids any one.

    Groups are the components of links between texts whose k-word shingle sets have a Jaccard similarity of ``similarity`` or more: all
    such links count, and no others. Texts without shingles are one group.
    """
    small_batches(df.sparkSession)
    limit, shown = Fraction(str(similarity)), df.columns
    # Names of the caller's columns can't clash with those needed here.
    id_col, text_col = (f"c{shown.index(c)}" for c in (id_col, text_col))
    df = df.toDF(*(f"c{i}" for i in range(len(shown))))
    lanes, wide = [f"_lane{i}" for i in range(LANES)], [f"_wide{i}" for i in range(WIDE)]
    fields = [*df.schema, *(StructField(c, LongType()) for c in ("_uid", "_node", *lanes, *wide))]
    at, n_lane_hashes = df.columns.index(text_col), -(-LANES * LANE_BITS // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            found = []
            for t in b.column(at).to_pylist():
                w = words(t)
                h = np.unique(hashes(shingles(w, k)))
                # Of equal shingle sets the words are equal too, and so are the lanes.
                of_words = wide_majority(hashes(list(set(w))), n_lane_hashes)[: LANES * LANE_BITS]
                found.append((uid, signed(xxhash.xxh3_64_intdigest(h.tobytes(), SEED)), *_longs(of_words, LANE_BITS), *_longs(wide_majority(h, WIDE))))
                uid += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * (2 + LANES + WIDE)
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[f.name for f in fields])

    marked = written(df.mapInArrow(run, StructType(fields)), "marked")
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_uid").alias("uid"))).alias("best")
    nodes = written(marked.groupBy(F.col("_node").alias("node"), *lanes, *wide).agg(best), "nodes")
    most = differing_bits(similarity)
    first = links(table_rows(nodes, [F.col(c) for c in lanes], LANE_RADIUS, LANE_BITS), nodes, wide, most, nearest_first=(most * 7 // 10, most * 8 // 10, most * 9 // 10))
    first = written(_similar(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), nodes, marked, text_col, k, limit), "links")
    so_far = nodes.select("node", F.col("best.uid").alias("_uid"))
    prefixes = written(_prefixes(marked, text_col, k, limit).join(so_far, "_uid").select("node", "size", "prefix", "parity"), "prefixes")
    found = written(first.unionByName(_similar(_with_hubs(prefixes, first, limit), nodes, marked, text_col, k, limit)), "links")
    second = _similar(_pairs(prefixes, components(found), limit), nodes, marked, text_col, k, limit)
    of = nodes.select("node", "best").join(components(found.unionByName(second)), "node", "left").select(F.coalesce("component", "node").alias("component"), "best")
    stay = of.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.uid").alias("_uid"))
    return marked.join(stay, "_uid", "left_semi").select(df.columns).toDF(*shown)
