import gzip
import hashlib
import heapq
import io
import random
from collections import Counter

import pytest

from lodequery.llm import queries, registry, warc
from lodequery.llm.shared import filesystem, new_folder
from tests.conftest import SF
from tests.oracle import assert_same


def test_op1_against_sql(spark):
    assert_same(queries.op1_warc_merge(spark, SF), registry.ORACLE["op1_warc_merge"], SF)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges_like_a_heap(k):
    r = random.Random(k)
    runs = [sorted((f"u{r.randrange(9)}", f"{r.randrange(5)}", r.choice([None, 1, 2]), f"f{i}", j, 1) for j in range(r.randrange(30))) if 0 else sorted(((f"u{r.randrange(9)}", f"{r.randrange(5)}", r.choice([None, 1, 2]), f"f{i}", j, 1) for j in range(r.randrange(30))), key=warc._sort_key) for i in range(k)]
    assert list(warc.LoserTree([iter(x) for x in runs])) == list(heapq.merge(*runs, key=warc._sort_key))


@pytest.mark.parametrize("url, key", [
    ("http://www.Example.com:80/A?b=C#d", "com,example)/a?b=c"), ("https://u:p@a.b.org", "org,b,a)/"), ("//x.y:8080/z", "y,x:8080)/z"), (None, ""), ("", ""), ("not a url#f", "not a url"),
])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def brute(rows):
    payload = {i: (h or "").encode() for i, (_, _, h) in enumerate(rows)}
    out = []
    for i, (p, u, _) in enumerate(rows):
        same = [rows[j][0] for j in payload if payload[j] == payload[i] and rows[j][0] is not None]
        revisit = len(payload[i]) >= 100 and list(payload.values()).count(payload[i]) > 1 and same and p != min(same)
        out.append((p, len(payload[i]), hashlib.sha256(payload[i]).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None, warc.url_key(u)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(9)
    rows = [(i, f"http://h{r.randrange(4)}.org/{r.randrange(6)}", r.choice(["<p>é copy</p>" * 20, "short", "", None, f"<p>{i}</p>" * 30])) for i in range(80)]
    return rows + [(None, None, "<p>é copy</p>" * 20), (7, "http://new\r\nline", "<q>only null has me</q>" * 9), (None, "x", "<i>null group</i>" * 20), (None, "y", "<i>null group</i>" * 20), (500, "z", "big" * 400_000), (500, "z", "big" * 400_000)]


@pytest.mark.parametrize("fan_in", [2, 64])
def test_cases_and_the_order_of_histories(spark, fan_in):
    rows = cases()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, digest string").repartition(5)
    got = warc.archive(df, "page_id", "url", "html", with_payload=True, fan_in=fan_in).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url_key) for r in got), key=repr) == brute(rows)
    order = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    want = Counter((p, (h or "").encode()) for p, _, h in rows)
    assert all(want[r.page_id, bytes(r.payload)] for r in got if r.record_type == "response")
    assert warc.archive(df.limit(0), "page_id", "url", "html").collect() == []


def test_archives_are_valid_gzip_members(spark):
    df = spark.createDataFrame(cases(), "page_id long, url string, html string")
    folder = new_folder(spark, "t")
    runs = warc.write_archives(df.coalesce(1), "page_id", "url", "html", folder)
    assert sum(r.n for r in runs.collect()) == df.count()
    fs, path = filesystem(folder)
    raw = b"".join(fs.open_input_stream(f.path, compression=None).read() for f in fs.get_file_info(warc.pa.fs.FileSelector(path)) if f.path.endswith(".warc.gz"))
    text = gzip.GzipFile(fileobj=io.BytesIO(raw)).read()
    assert text.count(b"WARC/1.1\r\n") == df.count()


@pytest.mark.parametrize("seed", range(20))
def test_reads_cover_all_places(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    monkeypatch.setattr(warc, "GAP", r.choice([0, 7, 50]))
    places, at = [], 0
    for i in range(r.randrange(40)):
        n = r.choice([1, 9, 60, 300])
        places.append((f"f{i // 15}", at, n, i))
        at += n + r.choice([0, 0, 5, 30, 500])
    got = list(warc.spans(places))
    assert [i for *_, numbers in got for i in numbers] == list(range(len(places)))
    for file, low, high, numbers in got:
        mine = [places[i] for i in numbers]
        assert {p[0] for p in mine} == {file} and (low, high) == (mine[0][1], max(p[1] + p[2] for p in mine))
        assert high - low <= 100 or len(numbers) == 1
        assert all(b[1] - a[1] - a[2] <= warc.GAP for a, b in zip(mine, mine[1:]))


def test_parts_follow_the_captures_and_the_driver_gets_few_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_ROWS", 40)
    monkeypatch.setattr(warc, "RUN_ROWS", 100)
    df = spark.createDataFrame([(i, f"http://h{i * 7919 % 1000}.org/", f"<p>{i}</p>") for i in range(1000)], "page_id long, url string, html string")
    folder = new_folder(spark, "t")
    runs = warc.write_archives(df, "page_id", "url", "html", folder)
    n = runs.count()
    assert n >= 10 and -(-n // 3) <= warc._longer(folder, runs, n, 3).count() < n
    index = warc.merge_runs(spark, folder, runs, 4, 3)
    sizes = [sum(1 for _ in warc._entries(folder, x)) for x in index]
    assert sum(sizes) == 1000 and len(index) >= 20 and max(sizes) <= 120
    got = [(r.url_key, r.timestamp) for r in warc.read_archives(spark, folder, index).collect()]
    assert len(got) == 1000 and got == sorted(got)


def test_few_captures_make_few_parts_whatever_the_shuffle_partitions(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i * 7919 % 1000}.org/", f"<p>{i}</p>") for i in range(1000)], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "LEAST_PART", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        folder = new_folder(spark, "t")
        index = warc.merge_runs(spark, folder, warc.write_archives(df, "page_id", "url", "html", folder))
        got = [(r.url_key, r.timestamp) for r in warc.read_archives(spark, folder, index).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 4 < len(index) <= 10
    assert len(got) == 1000 and got == sorted(got)


def test_each_archive_is_read_once_in_its_order(spark, monkeypatch):
    r = random.Random(5)
    df = spark.createDataFrame([(i, f"http://h{i * 7919 % 3000}.org/", "".join(r.choices("abcdefgh <>", k=3000))) for i in range(3000)], "page_id long, url string, html string").repartition(3)
    folder = new_folder(spark, "t")
    index = warc.merge_runs(spark, folder, warc.write_archives(df, "page_id", "url", "html", folder))
    fs, path = filesystem(folder)
    held = sum(f.size for f in fs.get_file_info(warc.pa.fs.FileSelector(path)) if f.path.endswith(".warc.gz"))
    monkeypatch.setattr(warc, "READ_BYTES", held // 50)
    monkeypatch.setattr(warc, "TASK_BYTES", held // 10)
    dealt = warc.entries_by_archive(spark, folder, index)
    tasks = dealt.rdd.mapPartitions(lambda rows: [[(x.file, x.offset, x.length) for x in rows]]).filter(len).collect()
    assert len(tasks) >= 8 and all(t == sorted(t) for t in tasks)
    reads = [s for t in tasks for s in warc.spans((*p, i) for i, p in enumerate(t))]
    assert sum(high - low for _, low, high, _ in reads) == held and len(reads) <= 50 + 3 + 2 * len(tasks)
    got = [(r.url_key, r.timestamp, r.page_id) for r in warc.read_archives(spark, folder, index).collect()]
    assert got == sorted(got) and len(got) == 3000
    assert sorted((r.url_key, r.timestamp, r.page_id) for r in warc.read_archives(spark, folder, index, in_order=False).collect()) == got


def test_a_damaged_record_is_refused():
    good = warc.record(1, "http://a", "20240101000000", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
    assert warc.parse(good)[2] == b"x" * 200
    bad = warc.record(1, "http://a", "20240101000000", b"y" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
    with pytest.raises(ValueError):
        warc._capture(("k", "t", 1, "f", 0, 1), bad, False)
