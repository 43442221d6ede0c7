"""Text, identifier and date helpers as built-in column expressions (no Python runs on executors)."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_space(col: Column) -> Column:
    """Runs of space, tab, CR and LF become one space; both ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(col, "[ \t\r\n]+", " "))


def make_id(prefix: str, key: Column) -> Column:
    """``prefix`` followed by the key. A null key gives null."""
    return F.concat(F.lit(prefix), key.cast("string"))


def now_id(prefix: str) -> Column:
    """``prefix`` and the query's start in epoch milliseconds: one value for a whole query, so not unique per row."""
    return make_id(prefix, F.unix_millis(F.current_timestamp()))


def millis_id(prefix: str, at: Column) -> Column:
    """``prefix`` and a time without zone in milliseconds since 1970, whatever the session's zone. A null time gives null."""
    since = (at - F.expr("TIMESTAMP_NTZ '1970-01-01'")).cast("interval second").cast("decimal(18, 6)")
    return make_id(prefix, F.floor(since * 1000).cast("long"))


def json_fields(col: Column, schema: str, bad: str = "_bad") -> Column:
    """The fields that a DDL string names, from text that holds a JSON object. Fields that are absent or of another type are null, others aren't read.
    Where the text isn't JSON, all are null and ``bad`` holds the text; a field of another type leaves the text there, too. Null stays null."""
    return F.from_json(col, f"{schema}, {bad} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})


def or_false(predicate: Column) -> Column:
    """A predicate that can't be decided (null) counts as false."""
    return F.coalesce(predicate, F.lit(False))


def parse_iso_date(text: str) -> date:
    """An ISO ``yyyy-MM-dd`` date; anything else raises ValueError instead of being guessed at."""
    if len(text) != 10:
        raise ValueError(f"not an ISO date: {text!r}")
    return date.fromisoformat(text)


def records_found_text(n: Column) -> Column:
    """The summary line of a search: none, one, or how many."""
    return F.when(n == 0, F.lit("No Records Found")).when(n == 1, F.lit("(1) Record Found")).otherwise(
        F.concat(F.lit("("), n.cast("string"), F.lit(") Records Found"))
    )
