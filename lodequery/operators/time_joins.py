"""Joins and frames by time that divide hot keys and need no nested loop.

Rows meet by (keys, slot of time), so the rows of one key, however many, are spread over as many tasks as it has slots. Slots are powers of two long.

Times are timestamps, or integers in a unit of the caller's choice; lengths are timedeltas or integers accordingly. Null keys and null times
find nothing; rows that have them stay where a side is kept as a whole. Repeated rows stay repeated, and an empty table gives what no match gives. Columns of any
name go along; a new column named like one that is there raises ValueError.
"""
from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, TimestampNTZType, TimestampType

#: Bits of the size classes of ranges: each is four times as long as the one before, from 65 milliseconds on if units are microseconds.
CLASS_BITS = list(range(16, 63, 2))


def _ticks(df: DataFrame, name: str) -> Column:
    """A time as a whole number: microseconds, or the integer itself. Times without zone don't depend on the session's."""
    kind = df.schema[name].dataType
    if isinstance(kind, TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, TimestampNTZType):
        return ((F.col(name) - F.expr("TIMESTAMP_NTZ '1970-01-01'")).cast("interval second").cast("decimal(18, 6)") * 1_000_000).cast("long")
    if isinstance(kind, IntegralType):
        return F.col(name).cast("long")
    raise TypeError(f"{name} is neither a timestamp nor an integer but {kind.simpleString()}")


def _length(value: timedelta | int) -> int:
    n = value // timedelta(microseconds=1) if isinstance(value, timedelta) else value
    if n <= 0:
        raise ValueError("a length of time has to be greater than zero")
    return n


def _bits(length: timedelta | int) -> int:
    """Of the shortest slot that is as long."""
    return (_length(length) - 1).bit_length()


def _keys(by: list[str]) -> list[Column]:
    return [F.col(k).alias(f"k{i}") for i, k in enumerate(by)]


def _new(names: list[str], df: DataFrame) -> None:
    lower = [n.lower() for n in (*df.columns, *names)]
    if clash := {n for n in lower[len(df.columns) :] if lower.count(n) > 1}:
        raise ValueError(f"columns that are there already: {', '.join(sorted(clash))}")


def _row(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def _taken(df: DataFrame, take: Mapping[str, str]) -> Column:
    return F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(take.values())))


def _given(take: Mapping[str, str], of: str) -> list[Column]:
    return [F.col(f"{of}.v{i}").alias(name) for i, name in enumerate(take)]


def as_of_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: Mapping[str, str], *,
    strict: bool = False, within: timedelta | int | None = None, slot: timedelta | int = timedelta(days=1),
) -> DataFrame:
    """Every left row, with columns of the latest right row of the same keys that isn't after it; with ``strict``, that is before it.

    ``take`` names the new columns and the right ones that they come from, which must be of types with an order; of right rows at one time the greatest in them counts.
    A match more than ``within`` back is none. One shuffle of both sides, by (keys, slot); what a slot inherits from those before it
    comes from a table with a row for each key and slot, in which only the last match of each is kept.
    """
    _new(list(take), left)
    bits = _bits(slot)
    ours = left.select(*_keys(by), _ticks(left, left_time).alias("t"), F.lit(not strict).alias("late"), _row(left).alias("row"), F.lit(None).alias("hit"))
    hits = right.select(*_keys(by), _ticks(right, right_time).alias("t"), F.lit(strict).alias("late"), F.lit(None).alias("row"), _taken(right, take).alias("v"))
    keys = [f"k{i}" for i in range(len(by))]
    hits = hits.dropna(subset=[*keys, "t"]).withColumn("hit", F.struct("t", "v")).drop("v")
    slotted = ours.unionByName(hits).withColumn("slot", F.shiftright("t", bits))
    # What each slot leaves to the next ones.
    ends = slotted.dropna(subset=[*keys, "slot"]).groupBy(*keys, "slot").agg(F.max("hit").alias("end"))
    before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.withColumn("inherited", F.last("end", ignorenulls=True).over(before)).drop("end")
    # Within a slot. In a strict join left rows come before right rows of their time, otherwise after them.
    so_far = Window.partitionBy(*keys, "slot").orderBy("t", "late", "hit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = slotted.withColumn("own", F.last("hit", ignorenulls=True).over(so_far)).filter("row IS NOT NULL")
    found = found.join(inherited, [*keys, "slot"], "left").withColumn("hit", F.coalesce("own", "inherited"))
    if within is not None:
        found = found.withColumn("hit", F.when(F.col("t") - F.col("hit.t") <= _length(within), F.col("hit")))
    return found.select("row.*", *_given(take, "hit.v"))


def interval_join(points: DataFrame, ranges: DataFrame, by: list[str], time: str, start: str, end: str, take: Mapping[str, str]) -> DataFrame:
    """A row for each point and each range of the same keys with start <= time < end: the point's columns and those that ``take`` names from the range.

    A range belongs to the class of the shortest slots that are as long as it, of which it touches two at most; a point has one slot in each class that
    occurs (one of 24 at most). So they meet by equality, each pair once, and neither long ranges nor a few very long ones among short ones make many rows.
    """
    _new(list(take), points)
    keys = [f"k{i}" for i in range(len(by))]
    low, high = _ticks(ranges, start), _ticks(ranges, end)
    sized = ranges.select(*_keys(by), low.alias("low"), high.alias("high"), _taken(ranges, take).alias("v")).dropna(subset=[*keys, "low", "high"]).filter("low < high")
    longer = F.filter(F.lit(CLASS_BITS[:-1]).cast("array<int>"), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b) < F.col("high") - F.col("low"))
    sized = sized.withColumn("class", F.element_at(F.lit(CLASS_BITS).cast("array<int>"), F.size(longer) + 1))
    classes = sorted(r[0] for r in sized.select("class").distinct().collect())  # 24 rows at most
    in_slots = sized.withColumn("slot", F.explode(F.sequence(F.call_function("shiftright", "low", "class"), F.call_function("shiftright", F.col("high") - 1, F.col("class")))))
    placed = points.select(*_keys(by), _ticks(points, time).alias("t"), _row(points).alias("row")).dropna(subset=[*keys, "t"])
    placed = placed.withColumn("class", F.explode(F.lit(classes).cast("array<int>"))).withColumn("slot", F.call_function("shiftright", "t", "class"))
    return placed.join(in_slots, [*keys, "class", "slot"]).filter("low <= t AND t < high").select("row.*", *_given(take, "v"))


def trailing(df: DataFrame, by: list[str], time: str, frame: timedelta | int, aggregates: Mapping[str, Column], slot: timedelta | int | None = None) -> DataFrame:
    """Every row, with aggregates over the rows of its keys from ``frame`` before it up to its time, others at that time included.

    Slots are four frames long, or so, unless given. A row near the end of a slot goes to the next one, too, and counts there without staying; so rows of one key are spread, and a quarter of
    them, or less, goes twice. Rows with a null time make a frame of their own, as in a window of SQL, and so do those with a null key.
    """
    _new(list(aggregates), df)
    back = _length(frame)
    bits = max(_bits(slot if slot is not None else 4 * back), _bits(back))  # a frame reaches into one slot before at most
    keys = [f"k{i}" for i in range(len(by))]
    hidden = [f"_{len(df.columns)}_{n}" for n in (*keys, "t", "slot", "own")]
    *ks, t, slot_name, own = hidden
    at = F.shiftright(t, bits)
    reaches = F.shiftright(F.col(t) + back, bits) > at
    here = F.struct(at.alias("slot"), F.lit(True).alias("own"))
    placed = df.select("*", *(F.col(k).alias(n) for k, n in zip(by, ks, strict=True)), _ticks(df, time).alias(t))
    placed = placed.withColumn(own, F.explode(F.when(reaches, F.array(here, F.struct((at + 1).alias("slot"), F.lit(False).alias("own")))).otherwise(F.array(here))))
    placed = placed.withColumn(slot_name, F.col(f"{own}.slot")).withColumn(own, F.col(f"{own}.own"))
    frame_of = Window.partitionBy(*ks, slot_name).orderBy(t).rangeBetween(-back, Window.currentRow)
    return placed.select("*", *(a.over(frame_of).alias(n) for n, a in aggregates.items())).filter(own).drop(*hidden)


def subtotals(df: DataFrame, keys: list[str], aggregates: Mapping[str, Column], level: str = "level") -> DataFrame:
    """Aggregates by all keys, by all but the last, and so on to the whole; ``level`` is how many keys a row is by, which tells a null key from a subtotal.

    One pass: every row goes through the partial aggregation of its task once for each level before anything is shuffled.
    """
    _new([level, *aggregates], df.select(*keys))
    # The grouping id has a set bit for each key that is left out, the last key's the lowest.
    made = df.rollup(*keys).agg(F.grouping_id().alias("_out"), *(a.alias(n) for n, a in aggregates.items()))
    return made.withColumn(level, (F.lit(len(keys)) - F.bit_count("_out")).cast("int")).drop("_out")
