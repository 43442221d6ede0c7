from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodequery import plans
from lodequery.sources.tables import load_table
from lodequery.streaming import drained, event_windows
from tests.conftest import SF
from tests.oracle import assert_same

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def files(spark, folder, parts):
    """A file for each part, in the order in which a stream takes them."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "t timestamp, k string, n long").coalesce(1).write.mode("append").parquet(folder)
        for f in spark._jvm.java.io.File(folder).listFiles():
            if f.getName().endswith(".parquet") and f.lastModified() > 10**12:
                f.setLastModified(10**12 - 10**9 + i * 10**6)


def counted(spark, folder, **more):
    stream = spark.readStream.schema("t timestamp, k string, n long").option("maxFilesPerTrigger", 1).parquet(folder)
    return event_windows(stream, "t", timedelta(minutes=10), timedelta(minutes=5), ["k"], {"rows": F.count(F.lit(1)), "total": F.sum("n")}, **more)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_hours_against_sql(spark, folder):
    df = plans.QUERIES["stream_hours"](spark, folder)
    assert df.count() > 50
    assert_same(df, plans.ORACLE["stream_hours"], folder)


def test_a_table_of_several_files(spark, tmp_path):
    load_table(spark, SF, "events").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    assert_same(plans.QUERIES["stream_hours"](spark, str(tmp_path)), plans.ORACLE["stream_hours"], SF)


def test_late_rows_count_until_their_window_has_gone(spark, tmp_path):
    files(spark, str(tmp_path / "in"), [
        [(at(1), "a", 1), (at(12), "a", 2), (None, "a", 100)],  # watermark at 7 minutes
        [(at(2), "a", 4), (at(3), None, 8)],  # late, but the first window still stands
        [(at(31), "a", 16)],  # watermark at 26 minutes
        [(at(32), "a", 256)],  # windows up to 20 go with this batch
        [(at(4), "a", 32), (at(21), "a", 64)],  # the first is too late, the second isn't
        [(at(60), "b", 128)],
    ])
    df, progress = drained(counted(spark, str(tmp_path / "in")))
    got = sorted(((r.start, r.end, r.k, r.rows, r.total) for r in df.collect()), key=str)
    assert got == sorted([(at(0), at(10), "a", 2, 5), (at(0), at(10), None, 1, 8), (at(10), at(20), "a", 1, 2), (at(20), at(30), "a", 1, 64), (at(30), at(40), "a", 2, 272)], key=str)
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1


def test_state_is_bounded(spark, tmp_path):
    files(spark, str(tmp_path / "in"), [[(at(30 * i + j), "a", 1) for j in range(30)] for i in range(8)])
    df, progress = drained(counted(spark, str(tmp_path / "in")))
    assert df.count() == 23 and df.agg(F.sum("rows")).first()[0] == 230  # the last window stays open
    assert max(s["numRowsTotal"] for p in progress for s in p["stateOperators"]) <= 5


def test_overlapping_windows_and_an_empty_folder(spark, tmp_path):
    files(spark, str(tmp_path / "in"), [[(at(7), "a", 1)], [(at(100), "a", 1)]])
    df, _ = drained(counted(spark, str(tmp_path / "in"), slide=timedelta(minutes=5)))
    assert sorted((r.start, r.rows) for r in df.collect()) == [(at(0), 1), (at(5), 1)]
    (tmp_path / "none").mkdir()
    assert drained(counted(spark, str(tmp_path / "none")))[0].collect() == []
    with pytest.raises(ValueError):
        event_windows(spark.readStream.schema("t timestamp").parquet(str(tmp_path / "in")), "t", timedelta(minutes=1), timedelta(minutes=-1), [], {"n": F.count("t")})
