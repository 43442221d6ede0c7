"""Queries that join and add up by time, with subtotals and JSON columns: each takes (spark, sf_dir) and returns a lazy DataFrame."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.text import json_fields
from lodequery.operators.time_joins import as_of_join, interval_join, subtotals, trailing
from lodequery.sources.tables import load_table, stream_table
from lodequery.streaming.windows import drained, event_windows

def _cents(name: str) -> Column:
    """Sums of whole cents don't depend on the order of the rows."""
    return F.round(F.col(name) * 100).cast("long")


def previous_event(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the latest earlier one of its user."""
    events = load_table(spark, d, "events").select("event_id", "user_id", "ts")
    return as_of_join(events, events, ["user_id"], "ts", "ts", {"previous_id": "event_id"}, strict=True).select("event_id", "user_id", "previous_id")


def purchase_of_two_days(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the user's latest purchase, itself included, if that is two days back at most."""
    events = load_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.filter("event_type = 'purchase'")
    found = as_of_join(events, bought, ["user_id"], "ts", "ts", {"purchase_id": "event_id", "purchase_value": "value"}, within=timedelta(days=2))
    return found.select("event_id", "purchase_id", "purchase_value")


def purchases_after_error(spark: SparkSession, d: str) -> DataFrame:
    """A user's purchases in the time that an error of theirs lasts, its value in quarters of an hour: from seconds to days."""
    events = load_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    errors = events.filter("event_type = 'error'").withColumn("until", F.col("ts") + F.make_dt_interval(secs=(_cents("value") * 9).cast("decimal(18, 6)")))
    return interval_join(events.filter("event_type = 'purchase'"), errors, ["user_id"], "ts", "ts", "until", {"error_id": "event_id"}).select("event_id", "error_id")


def week_sums(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the number and the sum of its user's events of the seven days up to it."""
    events = load_table(spark, d, "events").select("event_id", "user_id", "ts", _cents("value").alias("cents"))
    made = trailing(events, ["user_id"], "ts", timedelta(days=7), {"week_events": F.count(F.lit(1)), "week_cents": F.sum("cents")})
    return made.select("event_id", "week_events", "week_cents")


def order_subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and priority, by status, and all."""
    orders = load_table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", _cents("o_totalprice").alias("cents"))
    return subtotals(orders, ["o_orderstatus", "o_orderpriority"], {"n_orders": F.count(F.lit(1)), "cents": F.sum("cents")})


def props_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by a number in their JSON column, of those where it is 90 or more; the predicate and the count see no other part of it."""
    events = load_table(spark, d, "events").select(json_fields(F.col("props"), "k BIGINT").alias("p"))
    return events.filter("p.k >= 90").groupBy(F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n_events"))


def stream_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and kind, read as a stream to its end; hours that a row up to ten minutes late could still change aren't given."""
    made = event_windows(stream_table(spark, d, "events"), "ts", timedelta(hours=1), timedelta(minutes=10), ["event_type"], {"n_events": F.count(F.lit(1)), "cents": F.sum(_cents("value"))})
    return drained(made, "hours")[0]


QUERIES = {f.__name__: f for f in (previous_event, purchase_of_two_days, purchases_after_error, week_sums, order_subtotals, props_counts, stream_hours)}

ORACLE = {
    "previous_event": "SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS previous_id FROM events",
    "purchase_of_two_days": """SELECT e.event_id, CASE WHEN e.ts - p.ts <= INTERVAL 2 DAYS THEN p.event_id END AS purchase_id, CASE WHEN e.ts - p.ts <= INTERVAL 2 DAYS THEN p.value END AS purchase_value
        FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    "purchases_after_error": """SELECT b.event_id, e.event_id AS error_id FROM events b JOIN events e ON b.user_id = e.user_id AND b.event_type = 'purchase' AND e.event_type = 'error'
        AND epoch_us(b.ts) >= epoch_us(e.ts) AND epoch_us(b.ts) < epoch_us(e.ts) + round(e.value * 100)::BIGINT * 9000000""",
    "week_sums": """SELECT event_id, count(*) OVER w AS week_events, (sum(round(value * 100)::BIGINT) OVER w)::BIGINT AS week_cents FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""",
    "order_subtotals": """SELECT o_orderstatus, o_orderpriority, (2 - grouping(o_orderstatus) - grouping(o_orderpriority))::INTEGER AS level, count(*) AS n_orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "stream_hours": """SELECT "start", "start" + INTERVAL 1 HOUR AS "end", event_type, n_events, cents FROM (
        SELECT date_trunc('hour', ts)::TIMESTAMP AS "start", event_type, count(*) AS n_events, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2)
        WHERE "start" + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
    "props_counts": "SELECT k, count(*) AS n_events FROM (SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 90 GROUP BY k",
}
