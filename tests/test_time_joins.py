import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodequery import plans
from lodequery.functions.text import json_fields
from lodequery.operators import as_of_join, interval_join, subtotals, trailing
from tests.conftest import SF
from tests.oracle import assert_same

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["previous_event", "purchase_of_two_days", "purchases_after_error", "week_sums", "order_subtotals", "props_counts"])
def test_against_sql_at_two_sizes(spark, name):
    for folder in (SF, MIDDLE):
        assert_same(plans.QUERIES[name](spark, folder), plans.ORACLE[name], folder)
    assert plans.QUERIES[name](spark, MIDDLE).count() > 5


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["previous_event", "purchase_of_two_days", "purchases_after_error", "week_sums"])
def test_no_nested_loop(spark, name):
    shown = plan(plans.QUERIES[name](spark, SF))
    assert "NestedLoop" not in shown and "Cartesian" not in shown


def rows(r, n, keys=(1, 1, 1, 2, None), times=40):
    return [(i, r.choice(keys), r.choice([None, *range(-times, times)])) for i in range(n)]


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("strict, within", [(True, None), (False, None), (False, 7), (True, 3)])
def test_as_of_against_brute_force(spark, seed, strict, within):
    r = random.Random(seed)
    a, b = rows(r, 60) + [(7, 1, 3)] * 2, rows(r, 25) + [(90, 1, 3), (91, 1, 3), (91, 1, 3)]
    left, right = spark.createDataFrame(a, "id long, k long, t long"), spark.createDataFrame(b, "id long, k long, t long")
    want = []
    for i, k, t in a:
        hits = [(u, j) for j, q, u in b if None not in (k, t, q, u) and q == k and (u < t if strict else u <= t) and (within is None or t - u <= within)]
        want.append((i, k, t, max(hits)[1] if hits else None))
    got = as_of_join(left, right, ["k"], "t", "t", {"hit": "id"}, strict=strict, within=within, slot=r.choice([1, 5, 1000]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_as_of_of_empty_tables_and_clashing_names(spark):
    left = spark.createDataFrame([(1, 1, datetime(2024, 1, 1))], "row long, slot long, t timestamp")
    none = left.limit(0)
    assert [tuple(x) for x in as_of_join(left, none, ["slot"], "t", "t", {"hit": "row"}).collect()] == [(1, 1, datetime(2024, 1, 1), None)]
    assert as_of_join(none, left, ["slot"], "t", "t", {"hit": "row"}).collect() == []
    assert [x.hit for x in as_of_join(left, left, ["slot"], "t", "t", {"hit": "row"}).collect()] == [1]
    with pytest.raises(ValueError):
        as_of_join(left, left, ["slot"], "t", "t", {"ROW": "row"})
    with pytest.raises(TypeError):
        as_of_join(left.withColumn("t", F.lit("x")), left, ["slot"], "t", "t", {"hit": "row"})
    with pytest.raises(ValueError):
        as_of_join(left, left, ["slot"], "t", "t", {"hit": "row"}, within=0)


def test_a_hot_key_is_spread(spark):
    hot = spark.range(20_000).selectExpr("id", "1L AS k", "id AS t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (as_of_join(hot, hot.filter("id % 50 = 0"), ["k"], "t", "t", {"hit": "id"}, slot=64), trailing(hot, ["k"], "t", 20, {"n": F.count(F.lit(1))})):
            sizes = df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
            assert max(sizes) < 10_000 and sum(sizes) == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("seed", range(4))
def test_intervals_against_brute_force(spark, seed):
    r = random.Random(seed)
    unit = r.choice([1, 3000, 1 << 20])
    a = [(i, r.choice([1, 1, 2, None]), r.choice([None, r.randrange(-200, 200) * unit])) for i in range(80)]
    b = []
    for i in range(60):
        low = r.randrange(-220, 200) * unit
        b.append((i, r.choice([1, 1, 2, None]), r.choice([None, low, low, low]), r.choice([None, low, low - 1, low + 1, low + unit, low + 7 * unit, low + 300 * unit, low + (1 << 50)])))
    b += [b[-1], (99, 1, -(1 << 61), 1 << 61)]
    points, ranges = spark.createDataFrame(a, "id long, k long, t long"), spark.createDataFrame(b, "id long, k long, a long, b long")
    want = [(i, k, t, j) for i, k, t in a for j, q, low, high in b if None not in (k, t, q, low, high) and k == q and low <= t < high]
    got = interval_join(points, ranges, ["k"], "t", "a", "b", {"hit": "id"})
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert interval_join(points, ranges.limit(0), ["k"], "t", "a", "b", {"hit": "id"}).collect() == []
    assert interval_join(points.limit(0), ranges, ["k"], "t", "a", "b", {"hit": "id"}).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_trailing_against_brute_force(spark, seed):
    r = random.Random(seed)
    a = rows(r, 120)
    back = r.choice([1, 6, 500])
    want = []
    for i, k, t in a:
        mine = [j for j, q, u in a if q == k and ((t is None and u is None) or None not in (t, u) and t - back <= u <= t)]
        want.append((i, k, t, len(mine), sum(mine)))
    df = spark.createDataFrame(a, "id long, k long, t long")
    got = trailing(df, ["k"], "t", back, {"n": F.count(F.lit(1)), "total": F.sum("id")}, slot=r.choice([None, 1, 16]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert trailing(df.limit(0), ["k"], "t", back, {"n": F.count(F.lit(1))}).collect() == []


def test_times_without_zone_dont_depend_on_the_sessions(spark):
    df = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-03-31 01:30:00' + make_dt_interval(0, 0, 20 * CAST(id AS INT)) AS t, id FROM range(9)")
    want = [tuple(x) for x in as_of_join(df, df, ["k"], "t", "t", {"hit": "id"}, strict=True, within=timedelta(minutes=20)).orderBy("id").collect()]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = [tuple(x) for x in as_of_join(df, df, ["k"], "t", "t", {"hit": "id"}, strict=True, within=timedelta(minutes=20)).orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want and [h for *_, h in got] == [None, *range(8)]


def test_subtotals_tell_null_keys_from_totals(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, None, 4)], "p string, q string, n long")
    got = sorted(map(tuple, subtotals(df, ["p", "q"], {"total": F.sum("n")}).select("p", "q", "level", "total").collect()), key=str)
    assert got == sorted([("a", None, 2, 1), ("a", "x", 2, 2), (None, None, 2, 4), ("a", None, 1, 3), (None, None, 1, 4), (None, None, 0, 7)], key=str)
    with pytest.raises(ValueError):
        subtotals(df, ["p"], {"level": F.sum("n")})


def test_json_fields_of_bad_rows(spark):
    texts = ['{"k": 3}', '{"k": "three"}', '{"other": 1}', "{k", "", "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [(r.k, r.bad) for r in df.select("i", json_fields(F.col("t"), "k BIGINT").alias("p")).selectExpr("i", "p.k", "p._bad AS bad").orderBy("i").collect()]
    assert [k for k, _ in got] == [3, None, None, None, None, None, None]
    assert [b for _, b in got][:4] == [None, texts[1], None, "{k"] and got[6] == (None, None)
