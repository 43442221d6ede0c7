"""Search criteria: immutable predicates keyed by field, compiled to one Catalyst filter.

All predicates are built-in expressions with the bare column on one side, so equality and range
criteria reach the Parquet scan as pushed filters.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.functions.text import parse_iso_date

Predicate = Callable[[Column], Column]


def equals(value: object) -> Predicate:
    """Exact, case-sensitive equality."""
    return lambda c: c == F.lit(value)


def contains(value: str) -> Predicate:
    """Case-sensitive substring."""
    return lambda c: c.contains(value)


def date_range(first: str | None, last: str | None) -> Predicate:
    """Calendar days ``first`` to ``last``, both included; None leaves that end open.

    Built half-open, so that the whole last day counts whatever its time of day. The bounds are
    timestamps without zone, like the stored columns. An inverted range is empty.
    """
    lo = None if first is None else datetime.combine(parse_iso_date(first), time.min)
    hi = None if last is None else datetime.combine(parse_iso_date(last) + timedelta(days=1), time.min)

    def bound(at: datetime) -> Column:
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")

    def build(c: Column) -> Column:
        parts = ([c >= bound(lo)] if lo else []) + ([c < bound(hi)] if hi else [])
        return all_of(*parts)

    return build


def all_of(*parts: Column) -> Column:
    """Conjunction; true if there are no parts."""
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(*parts: Column) -> Column:
    """Disjunction; false if there are no parts."""
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


@dataclass(frozen=True)
class Search:
    """A set of criteria. Setting a field again replaces its criterion; ``reset`` drops all of them."""

    criteria: Mapping[str, Predicate] = field(default_factory=dict)

    def where(self, **criteria: Predicate) -> Search:
        return Search({**self.criteria, **criteria})

    def reset(self) -> Search:
        return Search()

    def predicate(self, df: DataFrame) -> Column:
        return all_of(*(p(df[c]) for c, p in self.criteria.items()))

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows that meet every criterion; without criteria the frame itself, so no filter node is planned."""
        return df.filter(self.predicate(df)) if self.criteria else df
