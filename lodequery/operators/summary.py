"""Counts, existence, single values and the n-th row of a group."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.text import or_false


def record_count(df: DataFrame) -> DataFrame:
    """One row, ``records_found``: partial counts per task, so only numbers are shuffled."""
    return df.agg(F.count(F.lit(1)).alias("records_found"))


def any_match(df: DataFrame, predicate: Column) -> DataFrame:
    """One row, ``found``: whether any row satisfies the predicate; nulls and an empty frame give false."""
    return df.agg(or_false(F.bool_or(or_false(predicate))).alias("found"))


def single_value(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """At most one row with one column."""
    return df.select(value.alias(name)).limit(1)


def nth_by(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The n-th row (from 1) of each group in an explicit order, which should be unique within a group.

    Spark turns ``row_number() <= n`` into a limit per group before the shuffle, so a hot group sends
    at most n rows from each task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).filter(F.col("_rank") == n).drop("_rank")
