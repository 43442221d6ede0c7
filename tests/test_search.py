import os
import shutil
import subprocess
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from lodequery import plans
from lodequery.functions.text import millis_id, normalize_space, now_id, or_false, parse_iso_date, records_found_text
from lodequery.operators import Search, Selector, any_match, contains, date_range, equals, nth_by, record_count, select_elements, single_value
from lodequery.sources import scratch
from lodequery.sources.tables import append_row, insert_once, inserted, load_table, write_table
from lodequery.streaming import stream_count, wait_for_rows
from tests.conftest import SF
from tests.oracle import assert_same

SQL_QUERIES = sorted(plans.ORACLE)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_against_sql(spark, name):
    assert_same(plans.QUERIES[name](spark, SF), plans.ORACLE[name], SF)


def test_entry(spark):
    assert driver.entry(spark).columns == ["records_found"]


def test_every_search_query_is_registered():
    assert set(plans.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.fixture(scope="module")
def moments(spark):
    at = [datetime(2024, 1, 9, 23, 59, 59, 999999), datetime(2024, 1, 10), datetime(2024, 1, 12, 23, 59, 59, 999999), datetime(2024, 1, 13), None]
    return spark.createDataFrame([(i, t) for i, t in enumerate(at)], "id long, ts timestamp_ntz")


def test_range_is_closed_on_days(moments):
    assert [r.id for r in Search().where(ts=date_range("2024-01-10", "2024-01-12")).apply(moments).collect()] == [1, 2]


def test_open_and_inverted_ranges(moments):
    ids = lambda s: sorted(r.id for r in s.apply(moments).collect())
    assert ids(Search().where(ts=date_range(None, "2024-01-09"))) == [0]
    assert ids(Search().where(ts=date_range("2024-01-13", None))) == [3]
    assert ids(Search().where(ts=date_range("2024-01-13", "2024-01-01"))) == []


@pytest.mark.parametrize("text", ["2024-31-12", "31-12-2024", "2024-1-2", "", "20240102"])
def test_only_iso_dates(text):
    with pytest.raises(ValueError):
        parse_iso_date(text)


def test_criteria_replace_and_reset(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    s = Search().where(v=equals("a")).where(v=equals("b"))
    assert [r.k for r in s.apply(df).collect()] == [2]
    assert s.reset().apply(df) is df
    assert [r.k for r in s.where(k=equals(1)).apply(df).collect()] == []
    assert [r.k for r in Search().where(v=contains("A")).apply(df).collect()] == []


def test_filter_reaches_the_scan(spark):
    plan = plans.QUERIES["date_range_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz>" in plan


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        load_table(spark, SF, "employees")
    with pytest.raises(ValueError):
        append_row(load_table(spark, SF, "region"), {"nope": 1})


def test_written_row_is_found_again(spark, tmp_path):
    region = load_table(spark, SF, "region")
    write_table(region, str(tmp_path / "r"))
    write_table(append_row(region.limit(0), {"r_regionkey": 77, "r_name": "X"}), str(tmp_path / "r"))
    again = spark.read.parquet(str(tmp_path / "r"))
    assert again.count() == region.count() + 1 and Search().where(r_name=equals("X")).apply(again).count() == 1


def test_summary_wording(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "n long")
    assert [r[0] for r in df.select(records_found_text(F.col("n"))).collect()] == ["No Records Found", "(1) Record Found", "(5) Records Found"]


def test_empty_frames(spark):
    df = spark.createDataFrame([], "k long, v string")
    assert record_count(df).first()[0] == 0
    assert any_match(df, F.col("k") == 1).first()[0] is False
    assert single_value(df, F.col("k")).collect() == []


def test_small_functions(spark):
    df = spark.createDataFrame([(" a \t\r\n b ",), (None,)], "v string")
    assert [r[0] for r in df.select(normalize_space(F.col("v"))).collect()] == ["a b", None]
    assert [r[0] for r in df.select(or_false(F.col("v") == "x")).collect()] == [False, False]
    assert df.select(now_id("EMP").alias("i")).first().i.startswith("EMP1")


def test_nth_row(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "g string, k long")
    assert [(r.g, r.k) for r in nth_by(df, 2, ["g"], [F.col("k")]).collect()] == [("a", 3)]


HTML = '<h1 class="big title">A <b>x</b></h1><p name="q">one</p><p>  two\n words </p><img src=a.png><p>one'


@pytest.mark.parametrize(
    "selector, expected",
    [
        (Selector(tag="p"), ["one", "two words", "one"]),
        (Selector(tag="p", text="one"), ["one", "one"]),
        (Selector(normal_text="two words"), ["two words"]),
        (Selector(tag="p", text_has="wo"), ["two words"]),
        (Selector(attrs=(("name", "q"),)), ["one"]),
        (Selector(attrs_have=(("class", "itl"),)), ["A x"]),
        (Selector(cls="itl"), []),
        (Selector(cls="title"), ["A x"]),
        (Selector(tag="p", nth=2), ["two words"]),
        (Selector(tag="p", nth=9), []),
        (Selector(tag="img"), [""]),
    ],
)
def test_selectors(selector, expected):
    assert [t for _, _, t in selector.select(HTML)] == expected


@pytest.mark.parametrize(
    "html, selector, expected",
    [
        ("<p>a<p>b<p>c", Selector(tag="p"), ["a", "b", "c"]),
        ("<ul><li>a<li>b</ul>", Selector(tag="li", normal_text="a"), ["a"]),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", Selector(tag="li"), ["a b c".replace(" ", ""), "b", "d"]),
        ("<p>a<div>b</div>c", Selector(tag="p"), ["a"]),
        ("<p>a<button><p>b</button>c</p>", Selector(tag="p"), ["abc", "b"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", Selector(tag="dt"), ["a", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", Selector(tag="td"), ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", Selector(tag="tr"), ["ab", "c"]),
        ("<table><tr><td><table><tr><td>a</table>b<td>c</table>", Selector(tag="td"), ["ab", "a", "c"]),
        ("<select><option>a<option>b</select>c", Selector(tag="option"), ["a", "b"]),
        ("<div>a</span>b</p></div>c", Selector(tag="div"), ["ab"]),
        ("<div><td>a</div></td>b</div>", Selector(tag="div"), ["ab"]),
        ("<p>a &amp; b<!-- x -->c", Selector(tag="p", text="a & b"), ["a & bc"]),
        ('<i a="1" a="2">x</i>', Selector(attrs=(("a", "1"),)), ["x"]),
        ("<p>x < y</p>", Selector(tag="p", text="x < y"), ["x < y"]),
    ],
)
def test_elements_that_close_by_themselves(html, selector, expected):
    assert [t for _, _, t in selector.select(html)] == expected


@pytest.mark.parametrize("name, n", [("html_by_tag", 2), ("html_text_contains", 2), ("html_locators", 3)])
def test_cut_references_and_paragraphs_in_open_formatting(spark, tmp_path, name, n):
    page = '<html><body><div class="ad">x</div><article><h1>{0}</h1><p><b>{0}<br><p>nation &amp; on</p><p>none<p><i>action</i></p></article><footer>y</footer></body></html>'
    pages = [(1, page.format("Station &amp;&amp")), (2, page.format("A &copy;&quot"))]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = plans.QUERIES[name](spark, str(tmp_path))
    assert_same(found, plans.ORACLE[name], str(tmp_path))
    assert found.filter("text like '%amp' or text like '%quot' or text = 'nation & on'").count() == n


@pytest.mark.parametrize("unit", ["<p>word ", "<li>word ", "<div>", "<div></span>", "<button><p>", "<b>x", "<table><tr><td>x"])
def test_time_is_linear_in_the_page(unit):
    started = time.perf_counter()
    assert Selector(tag="h1", normal_text="none").select(unit * 30_000) == []
    assert time.perf_counter() - started < 5


def test_without_the_training_data_folders(tmp_path):
    """What is left imports, and registers its own queries alone."""
    root = Path(driver.__file__).parent
    shutil.copytree(root / "lodequery", tmp_path / "lodequery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as d, lodequery.plans as p; assert set(d.queries()) == set(p.QUERIES) and set(d.oracle_sql()) == set(p.ORACLE)"
    for extra in ((), ("corpus_pipeline.py",)):
        for f in ("__spark_entry__.py", *extra):
            if (root / f).exists():
                shutil.copy(root / f, tmp_path / f)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})


#: Queries that are about finding nothing.
NOTHING = {"empty_range_count"}


@pytest.mark.parametrize("name", sorted(set(plans.ORACLE) - NOTHING))
def test_queries_find_something(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


class Unset:
    """A session whose configuration names no shared folder."""

    def __init__(self, spark, master):
        self.sparkContext, self._jvm, self._jsc, self.conf = self, spark._jvm, spark._jsc, self
        self.applicationId, self.master = spark.sparkContext.applicationId, master

    def get(self, key, default):
        return default


def test_the_shared_folder(spark):
    assert scratch.scratch_folder(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
    first = scratch.shared_root(Unset(spark, "local[4]"))
    assert first == scratch.shared_root(Unset(spark, "local")) and first.startswith("file:/") and scratch.qualified(spark, "/a/b") == "file:/a/b"
    with pytest.raises(ValueError):
        scratch.shared_root(Unset(spark, "local-cluster[3,2,1000]"))
    folder = scratch.scratch_folder(spark, "gone")
    spark.range(3).write.parquet(folder)
    assert scratch.remove(spark, folder) and not scratch.remove(spark, folder)


ENDING = """
import sys
from pyspark.sql import SparkSession
from lodequery import plans
from lodequery.sources import scratch
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
for name in ("write_then_lookup", "insert_again_then_count"):
    assert plans.QUERIES[name](spark, sys.argv[2]).count() == 1
print("before", len(scratch._made), scratch.remove_all() if sys.argv[3] == "now" else "")
plans.QUERIES["write_then_lookup"](spark, sys.argv[2]).collect()
if sys.argv[3] == "stopped":
    spark.stop()
"""


@pytest.mark.parametrize("how", ["now", "open", "stopped"])
def test_nothing_is_left_in_the_shared_folder(tmp_path, how):
    root = Path(driver.__file__).parent
    (tmp_path / "shared").mkdir()
    done = subprocess.run([sys.executable, "-c", ENDING, f"file://{tmp_path}/shared", SF, how], cwd=root, check=True, timeout=240, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(root)})
    assert done.stdout.split()[:3] == (["before", "2", "2"] if how == "now" else ["before", "2"])
    assert not [p for p in (tmp_path / "shared").iterdir() if p.name.startswith(("region-", "customers-"))]


def test_select_elements(spark):
    df = spark.createDataFrame([(1, HTML, "x"), (2, None, "y"), (3, "", "z")], "page_id long, html string, position string")
    got = select_elements(df, "page_id", "html", Selector(tag="p", nth=1)).collect()
    assert [tuple(r) for r in got] == [(1, 1, "p", "one")]


def test_stream_counts_like_a_batch(spark, tmp_path):
    events = load_table(spark, SF, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    search = Search().where(ts=date_range("2024-01-10", "2024-01-12"))
    q = stream_count(spark, str(tmp_path / "in"), events.schema, search).writeStream.outputMode("complete").format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("found").first()[0] == record_count(search.apply(events)).first()[0]


def test_ids_by_the_clock(spark):
    before = int(time.time() * 1000)
    first, second = (int(spark.range(2).select(now_id("EMP").alias("i")).first().i[3:]) for _ in range(2))
    assert before <= first <= second <= int(time.time() * 1000) and spark.range(50).select(now_id("E")).distinct().count() == 1
    df = spark.createDataFrame([(datetime(2024, 1, 10, 1, 2, 3, 456789),), (datetime(1969, 12, 31, 23, 59, 59),), (None,)], "at timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert [r[0] for r in df.select(millis_id("E", F.col("at"))).collect()] == ["E1704848523456", "E-1000", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_an_insert_that_is_tried_again_leaves_its_rows_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    rows = [spark.createDataFrame([(i, f"n{i}")], "k long, v string") for i in range(3)]
    got = lambda: sorted(map(tuple, inserted(spark, path, rows[0].schema).collect()))
    assert insert_once(rows[0], path, "a") and not insert_once(rows[0], path, "a") and got() == [(0, "n0")]
    assert not insert_once(rows[1], path, "a") and insert_once(rows[1], path, "b/../c é") and got() == [(0, "n0"), (1, "n1")]
    # What a writer left that was lost before the rename isn't seen, and doesn't stand in the way.
    rows[2].write.parquet(f"{path}/_{'0' * 64}-lost")
    assert got() == [(0, "n0"), (1, "n1")] and insert_once(rows[2], path, "c") and got() == [(0, "n0"), (1, "n1"), (2, "n2")]
    failing = rows[0].select((F.raise_error(F.lit("lost"))).cast("long").alias("k"), "v")
    with pytest.raises(Exception, match="lost"):
        insert_once(failing, path, "d")
    assert insert_once(spark.createDataFrame([(9, None)], "k long, v string"), path, "d") and got()[-1] == (9, None)
    assert [p.name[0] for p in (tmp_path / "t").iterdir()].count("_") == 1


def test_two_inserts_of_one_key_at_once_leave_one(spark, tmp_path):
    path, key = f"file://{tmp_path}/t", "same"
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: insert_once(df, path, key), range(4)))
    assert done.count(True) == 1 and inserted(spark, path, df.schema).count() == 1


def test_waiting_ends_with_the_rows_or_the_time(spark, tmp_path):
    events, folder = load_table(spark, SF, "events"), tmp_path / "in"
    folder.mkdir()
    clicks = Search().where(event_type=equals("click"))
    events.filter("event_type != 'click'").limit(20).write.mode("append").parquet(f"file://{folder}")
    began = time.monotonic()
    assert wait_for_rows(spark, str(folder), events.schema, clicks, 4) == 0 and 4 <= time.monotonic() - began < 30
    late = threading.Timer(3, lambda: events.filter("event_type = 'click'").limit(7).coalesce(1).write.mode("append").parquet(f"file://{folder}"))
    late.start()
    began = time.monotonic()
    assert wait_for_rows(spark, str(folder), events.schema, clicks, 90, rows=5) == 7 and time.monotonic() - began < 60
    late.join()
    assert wait_for_rows(spark, str(folder), events.schema, clicks, 60, rows=7) == 7
    assert not [p for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("wait-*")]
