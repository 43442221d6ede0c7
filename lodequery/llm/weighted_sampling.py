"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document's terms are its words with their counts as weights. For each of SAMPLES hash functions a term's
weight w is quantised on a grid that the term alone decides: r and c are Gamma(2, 1) and b uniform, all from the term's hash,
t = floor(ln w / r + b), and ln a = ln c - r (t - b + 1). The term with the least a is the sample; two
documents have the same one with a probability equal to their generalised Jaccard similarity, the sum
of the smaller weights over the sum of the larger. As a is a function of the sampled term and its t, the fingerprint
holds the least a themselves, in the form exp(-a), and likeness is the part of the samples that are equal.

Plan. Documents are dealt once, with their texts, into buckets of neighbouring ids; the first document of each
bucket is copied to the bucket before it, so that each row finds its successor in its own bucket. All later
steps (words, counts, samples, successors) group by the bucket first and need no further exchange. Bounds of buckets
are quantiles of the ids; their number follows the input's bytes (BUCKET_BYTES each) and, for small inputs, the shuffle partitions.

Defined results: a null text is an empty one; an empty text has no samples, is like another empty text (1) and unlike any
other (0), and has a fingerprint of zeros; very long texts are taken whole, a row per word at a time; null ids come last in descending order, rows with equal ids in the order of
their texts; a single document is its own successor; an empty table gives no rows. Only the two columns named are read, so others can't clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
#: Samples that one row evaluates: keeps the generated code small enough to be compiled well.
STEP = 4
BUCKETS_PER_TASK = 4
#: Bytes of the input, as the planner knows them, in a bucket.
BUCKET_BYTES = 1 << 28
#: Their bounds are literals of the plan: beyond this number, more bytes go to each.
MOST_BUCKETS = 20_000
#: Spark puts down sizes that it doesn't know as far beyond this.
_UNKNOWN = 1 << 60


def _bounds(df: DataFrame, id_col: str) -> list[int]:
    """Ascending first ids of the buckets but the lowest."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < _UNKNOWN else 0
    n = max(BUCKETS_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(known // BUCKET_BYTES, MOST_BUCKETS))
    return sorted({int(x) for x in df.select(F.col(id_col).cast("double")).approxQuantile(id_col, [i / n for i in range(1, n)], 0.1 / n)})


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key, found in two steps of about the root of their number; 0 for a null key."""
    if not bounds:
        return F.lit(0)
    side = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    below = lambda cells: F.size(F.filter(cells, lambda c: c <= key))
    row = F.greatest(below(F.lit([r[0] for r in rows]).cast("array<bigint>")), F.lit(1))
    cells = F.element_at(F.array(*(F.lit(r).cast("array<bigint>") for r in rows)), row)
    return F.coalesce((row - 1) * side + below(cells), F.lit(0))


def successors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in buckets of descending ids: ``bucket``, ``pos`` (from 1), ``copied`` (stands there only as a successor), ``id``, ``text`` and ``next_text``."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = _bounds(docs, "id")
    placed = docs.withColumn("bucket", _bucket(F.col("id"), bounds))
    heads = {r.bucket: r.head for r in placed.groupBy("bucket").agg(F.max("id").alias("head")).collect()}  # a row for each bucket
    used = sorted(heads)
    # The head of each bucket follows the last of the next higher one, the highest head the last of all.
    head_of = F.lit([heads.get(b) for b in range(len(bounds) + 1)]).cast("array<bigint>") if used else F.lit([0]).cast("array<bigint>")
    before = dict(zip(used, used[1:] + used[:1], strict=True))
    before_of = F.lit([before.get(b, 0) for b in range(len(bounds) + 1)])
    places = F.array(F.struct(F.col("bucket"), F.lit(0).alias("copied")))
    more = F.array(F.struct(F.element_at(before_of, F.col("bucket") + 1).alias("bucket"), F.lit(1).alias("copied")))
    is_head = F.col("id").eqNullSafe(F.element_at(head_of, F.col("bucket") + 1))
    dealt = placed.withColumn("place", F.explode(F.when(is_head, F.concat(places, more)).otherwise(places)))
    dealt = dealt.select("id", "text", F.col("place.bucket").alias("bucket"), F.col("place.copied").alias("copied"))
    order = Window.partitionBy("bucket").orderBy("copied", F.desc_nulls_last("id"), "text")
    return dealt.withColumn("pos", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def edit(text: Column, following: Column) -> Column:
    """The text whose last third (rounded down) is replaced by as much of the start of the one that follows."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def _spaced(text: Column) -> Column:
    for space in "\n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def _weights(rows: DataFrame) -> DataFrame:
    """bucket, pos, the hash ``h`` of each term and its counts w0 in the text of a row and w1 in its edited text, in the order of the rows.

    Both texts start with the same words, which are cut out and counted once: all before the last space that they share.
    """
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    texts = rows.select("bucket", "pos", (n - k).alias("n"), k.alias("k"), _spaced(F.col("text")).alias("text"), F.substring("next_text", F.lit(1), k).alias("new"))
    texts = texts.select("*", F.substring("text", F.lit(1), F.col("n")).alias("head")).withColumn("torn", F.substring_index("head", " ", -1))
    shared = F.substring("head", F.lit(1), F.col("n") - F.length("torn"))
    ends = [F.concat("torn", F.substring("text", F.col("n") + 1, F.col("k"))), F.concat("torn", _spaced(F.coalesce("new", F.lit(""))))]
    cut = texts.select("bucket", "pos", *(F.split(t, " ").alias(f"t{i}") for i, t in enumerate((shared, *ends))))
    found = cut.select("bucket", "pos", F.size("t0").alias("n0"), F.size("t1").alias("n1"), F.posexplode(F.concat("t0", "t1", "t2")).alias("at", "term")).filter("term != ''")
    both, first = F.col("at") < F.col("n0"), F.col("at") < F.col("n0") + F.col("n1")
    side = found.select("bucket", "pos", F.xxhash64("term").alias("h"), F.when(first, 1).otherwise(0).alias("in0"), F.when(both | ~first, 1).otherwise(0).alias("in1"))
    # Rows of one document stand together: what is gathered for it stays in the processor's cache.
    return side.groupBy("bucket", "pos", "h").agg(F.sum("in0").alias("w0"), F.sum("in1").alias("w1")).sortWithinPartitions("bucket", "pos")


def _uniform(bits: Column, n: int) -> Column:
    """The low n bits as a number in (0, 1)."""
    return (bits.bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)) * F.lit(2.0**-n)


def _samples(weights: DataFrame) -> DataFrame:
    """bucket, pos and s0, s1: the arrays of SAMPLES greatest values exp(-a) (null where a text has no term).

    Of weight 1, a = c p with p = exp(-r (1 - b)), which is uniform; so a is exponential and exp(-a) a uniform number u. Every term needs that, and
    only terms of greater weight need the rest, drawn given u: c - a is exponential and doesn't depend on a, -ln p = e = ln(c / a), and r = e + f, with
    f = r b exponential, too. So r and c are Gamma(2, 1), b is uniform, and none depends on the others. ln a falls by r with each step of t, and t is
    0 for weights below c / a, as for 1.
    """
    n = range(STEP)
    logs = [F.when(F.col(f"w{i}") > 1, F.log(f"w{i}")).alias(f"lw{i}") for i in range(2)]
    rows = weights.select("bucket", "pos", "h", "w0", "w1", F.greatest("w0", "w1").alias("w"), *logs, F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1), F.lit(STEP))).alias("step"))
    kept = ["bucket", "pos", "step", "w0", "w1", "w", "lw0", "lw1"]

    def then(keep: str, **new) -> DataFrame:
        """rows with the columns of each sample named in keep, and new ones made of them."""
        of = lambda j: {k: F.col(f"{k}{j}") for k in "xuyacqrfv"}
        return rows.select(*kept, *(f"{k}{j}" for k in keep for j in n), *(f(of(j)).alias(f"{k}{j}") for k, f in new.items() for j in n))

    rows = rows.select(*kept, *(F.xxhash64("h", F.col("step") + j).alias(f"x{j}") for j in n))
    heavy = F.col("w") > 1
    rows = then("", u=lambda s: _uniform(F.shiftrightunsigned(s["x"], 12), 52), y=lambda s: F.when(heavy, F.xxhash64(s["x"])))
    rows = then("uy", a=lambda s: F.when(heavy, -F.log(s["u"])))
    rows = then("uya", q=lambda s: F.when(heavy, 1 - F.log(_uniform(F.shiftrightunsigned(s["y"], 32), 32)) / s["a"]))  # c / a
    rows = then("uaq", f=lambda s: F.when(F.col("w") >= s["q"], -F.log(_uniform(s["y"], 32))))
    rows = then("uaqf", r=lambda s: F.when(F.col("w") >= s["q"], F.log(s["q"]) + s["f"]))

    def value(s: dict[str, Column], w: Column, lw: Column) -> Column:
        stepped = F.exp(-s["a"] * F.exp(-s["r"] * F.floor((lw + s["f"]) / s["r"])))
        return F.when(w == 1, s["u"]).when(w > 1, F.when(w < s["q"], s["u"]).otherwise(stepped))

    rows = then("uaqfr", v=lambda s: value(s, F.col("w0"), F.col("lw0")))
    second = lambda s: F.when(F.col("w1") == F.col("w0"), s["v"]).otherwise(value(s, F.col("w1"), F.col("lw1")))
    of = lambda j: {k: F.col(f"{k}{j}") for k in "uaqfrv"}
    most = rows.groupBy("bucket", "pos", "step").agg(*(F.max(f"v{j}").alias(f"v0_{j}") for j in n), *(F.max(second(of(j))).alias(f"v1_{j}") for j in n))
    parts = F.sort_array(F.collect_list(F.struct("step", *(F.array(*(F.col(f"v{i}_{j}") for j in n)).alias(f"v{i}") for i in range(2)))))
    return most.groupBy("bucket", "pos").agg(parts.alias("p")).select("bucket", "pos", *(F.flatten(F.col(f"p.v{i}")).alias(f"s{i}") for i in range(2)))


def likeness(a: Column, b: Column) -> Column:
    """The part of equal samples."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(SAMPLES))


def fingerprint(samples: Column) -> Column:
    """Four hexadecimal digits for each sample; zeros if there is none."""
    digit = lambda v: F.coalesce(F.substring(F.lpad(F.hex(F.xxhash64(v)), 16, "0"), 13, 4), F.lit("0000"))
    return F.lower(F.array_join(F.transform(samples, lambda v: F.when(v.isNull(), "0000").otherwise(digit(v))), ""))


def fingerprint_edits(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next`` of every row."""
    rows = successors(df, id_col, text_col)
    edited = edit(F.col("text"), F.coalesce("next_text", F.lit("")))
    samples = _samples(_weights(rows))
    facts = rows.select("bucket", "pos", "copied", "id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    none = F.array_repeat(F.lit(None).cast("double"), SAMPLES)
    joined = facts.join(samples, ["bucket", "pos"], "left").withColumns({f"s{i}": F.coalesce(f"s{i}", none) for i in range(2)})
    ahead = F.lead("s0").over(Window.partitionBy("bucket").orderBy("pos"))
    kept = joined.withColumn("next", ahead).filter("copied = 0")
    return kept.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("s0")).alias("fingerprint"), fingerprint(F.col("s1")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1")).alias("near_edited"), likeness(F.col("s0"), F.col("next")).alias("near_next"),
    )


__all__ = ["fingerprint_edits", "likeness", "successors", "edit"]
