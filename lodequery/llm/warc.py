"""WARC archives of captures with an external-merge index that orders all capture histories.

Writing. Every task writes the records of its rows, one gzip member each, and after every RUN_ROWS captures a run:
their index entries sorted by URL key and timestamp. Equal payloads of at least LEAST_REVISIT bytes are stored once, by the
capture with the smallest id; the others become revisit records that refer to it.

Merging. Runs are merged k ways by a loser tree: the inner nodes of a tournament keep the losers, so the next
entry costs one comparison a level. What describes the runs is a table in the shared folder, not a list on the driver: while it has more than FAN_IN rows,
tasks merge FAN_IN of them at a time into longer runs. The last merge is dealt to tasks by ranges of the sort key, of PART_ROWS captures or so, which come from keys
that the last FAN_IN runs sample at even distances; a task reads only the row groups that reach into its range. The parts, one after the other, are the
captures in the order of URL key and timestamp. Memory is FAN_IN row groups, whatever the number of captures; the driver holds a few keys and a name for each PART_ROWS captures.

Reading goes through the archives, not through the index: its entries are dealt to tasks by ranges of (archive, place) of TASK_BYTES of records or so, and neighbouring
places (less than GAP apart) are one read of READ_BYTES at most, so each archive is read once, from its beginning to its end, whatever the order of the histories. What was read then
goes back to the part and the place that it has in the index. The digest of each payload read is held against its record's.

Files are written under names of their own, and only those named by tasks that ended well are used.

Defined results: a null payload is an empty one; a null URL has an empty key and no target; without a time column a capture's time is
EPOCH plus its id in seconds; null ids come first and never lead a group that has others; rows with the smallest id of a group are all responses;
an empty table gives no rows. A very long payload is written and read whole, one at a time in memory. Columns other than those named are never read, so their names don't matter.
"""
from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.llm.shared import batched, filesystem, new_folder, one_task_each, small_batches, written

LEAST_REVISIT, RUN_ROWS, FAN_IN, GROUP_ROWS, SAMPLED = 100, 200_000, 64, 4096, 32
#: Captures of a part of the index, at most about; a part's bounds are sampled eight times as finely. Parts of fewer than LEAST_PART are made only for cores that would idle.
PART_ROWS, LEAST_PART = 1_000_000, 4096
#: Bytes of records that a task reads from archives in all and at a time, those of one read, and those between two places that one read takes along.
TASK_BYTES, BATCH_BYTES, READ_BYTES, GAP = 1 << 27, 1 << 24, 1 << 22, 1 << 16
EPOCH = datetime(2024, 1, 1)
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:captures")
#: Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Index entries sort by their first three fields, then by place.
ENTRY = pa.schema([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query, in lower case; without scheme, www., default port and fragment."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?", url or "", re.IGNORECASE)
    if m is None:
        return (url or "").partition("#")[0].lower()
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return f"{','.join(reversed(m[1].split('.')))}{port}){m[3] or '/'}{m[4] or ''}".lower()


def capture_time(page_id: int | None) -> str:
    """Fourteen digits."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**10)).strftime("%Y%m%d%H%M%S")


def record(page_id: int | None, url: str | None, time: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """A record as one gzip member; a revisit of the capture ``first`` if that isn't None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if first is not None else http + payload
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<{uuid.uuid5(_SPACE, str(page_id)).urn}>",
        "WARC-Date": f"{time[:4]}-{time[4:6]}-{time[6:8]}T{time[8:10]}:{time[10:12]}:{time[12:]}Z",
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Page-ID": None if page_id is None else str(page_id),
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{uuid.uuid5(_SPACE, str(first)).urn}>", "Refers-To-Page-ID": str(first)} if first is not None else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record fields, HTTP fields, payload) of a record; both fields' names as written. Raises ValueError for anything else."""
    raw = zlib.decompress(member, 31)
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def roles(df: DataFrame, id_col: str, url_col: str, html_col: str, time_col: str | None) -> DataFrame:
    """id, url, time, html, digest and first: the id of the capture that a row revisits, or null.

    Only digests that repeat are joined back, so a group of copies however large is one row on that side; the rows of a large one are split by adaptive execution (skewed join).
    """
    docs = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), (F.col(time_col).cast("string") if time_col else F.lit(None).cast("string")).alias("time"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    docs = docs.withColumn("digest", F.sha2("html", 256))
    groups = docs.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND least IS NOT NULL").select("digest", "least")
    return docs.join(groups, "digest", "left").select("id", "url", "time", "html", "digest", F.when(~F.col("id").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def _sort_key(e: tuple) -> tuple:
    return e[0], e[1], e[2] is not None, e[2] or 0, e[3], e[4]


def _write_run(folder: str, entries: Iterable[tuple], n: int) -> tuple[str, int, list[tuple]]:
    """(name, entries, keys at even distances) of a run of sorted entries."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    name, count, keys = f"run-{uuid.uuid4().hex}.parquet", 0, []
    every = max(1, min(n // SAMPLED, PART_ROWS // 8))
    with fs.open_output_stream(f"{path}/{name}") as out, pq.ParquetWriter(out, ENTRY, compression="zstd") as w:
        for b in batched(iter(entries), ENTRY, GROUP_ROWS):
            w.write_batch(b, row_group_size=GROUP_ROWS)
            for i in range((-count) % every, b.num_rows, every):
                keys.append(tuple(b.column(c)[i].as_py() for c in range(3)))
            count += b.num_rows
    return name, count, keys


_RUN = "name string, n long, keys array<struct<url_key:string,timestamp:string,page_id:long>>"
_RUN_ARROW = pa.schema([("name", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.struct([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64())])))])


def _described(name: str, n: int, keys: list[tuple]) -> pa.RecordBatch:
    shown = [dict(zip(("url_key", "timestamp", "page_id"), k, strict=True)) for k in keys]
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([shown], _RUN_ARROW.field("keys").type)], schema=_RUN_ARROW)


def write_archives(df: DataFrame, id_col: str, url_col: str, html_col: str, folder: str, time_col: str | None = None) -> DataFrame:
    """Archives and sorted runs under ``folder``; a table in the shared folder with a row (name, n, keys) for each run."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        name, out, at, entries = f"captures-{uuid.uuid4().hex}.warc.gz", None, 0, []
        for b in batches:
            for page, url, time, html, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                time = time or capture_time(page)
                member = record(page, url, time, html.encode(), digest, first)
                out.write(member)
                entries.append((url_key(url), time, page, name, at, len(member)))
                at += len(member)
                if len(entries) == RUN_ROWS:
                    yield _described(*_write_run(folder, sorted(entries, key=_sort_key), len(entries)))
                    entries = []
        if out is not None:
            out.close()
        if entries:
            yield _described(*_write_run(folder, sorted(entries, key=_sort_key), len(entries)))

    return written(roles(df, id_col, url_col, html_col, time_col).mapInArrow(run, _RUN), "runs")


class LoserTree:
    """Merges sorted iterators. losers[1:] are the inner nodes of a tournament over the heads; losers[0] is its winner."""

    def __init__(self, sources: list[Iterator[tuple]], key=_sort_key):
        self._sources, self._key, self._k = sources, key, len(sources)
        self._heads: list[tuple | None] = [None] * self._k
        self._keys: list[tuple] = [(1,)] * self._k
        for i in range(self._k):
            self._pull(i)
        self._losers = [-1] * max(1, self._k)
        for i in range(self._k):
            self._replay(i, building=True)

    def _pull(self, i: int) -> None:
        self._heads[i] = next(self._sources[i], None)
        # A source at its end loses to all others.
        self._keys[i] = (1,) if self._heads[i] is None else (0, *self._key(self._heads[i]))

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + self._k) // 2
        while node:
            other = self._losers[node]
            if other < 0 and building:
                self._losers[node] = i
                return
            if (self._keys[other], other) < (self._keys[i], i):
                self._losers[node], i = i, other
            node //= 2
        self._losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self._k and (head := self._heads[i := self._losers[0]]) is not None:
            yield head
            self._pull(i)
            self._replay(i)


def _entries(folder: str, name: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """Entries of a run with low <= sort key < high, from the row groups that may have some."""
    fs, path = filesystem(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        file = pq.ParquetFile(f)
        for g in range(file.metadata.num_row_groups):
            s = file.metadata.row_group(g).column(0).statistics
            if s is not None and s.has_min_max and (high is not None and s.min > high[0] or low is not None and s.max < low[0]):
                continue
            for b in file.iter_batches(GROUP_ROWS, row_groups=[g]):
                for e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    k = _sort_key(e)
                    if (low is None or k >= low) and (high is None or k < high):
                        yield e


def _longer(folder: str, runs: DataFrame, count: int, fan_in: int) -> DataFrame:
    """The table of the runs that come of merging at most fan_in of them each."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        for group in (held[i : i + fan_in] for i in range(0, len(held), fan_in)):
            yield _described(*_write_run(folder, LoserTree([_entries(folder, x) for x, _ in group]), sum(n for _, n in group)))

    # Dealt round robin, so a task has about fan_in names; one that has more merges them fan_in at a time.
    return written(runs.select("name", "n").repartition(-(-count // fan_in)).mapInArrow(merged, _RUN), "runs")


def merge_runs(spark: SparkSession, folder: str, runs: DataFrame, parts: int | None = None, fan_in: int = FAN_IN) -> list[str]:
    """Names of the index's parts, in order: one for each PART_ROWS captures, and ``parts`` at least (by default the session's shuffle partitions, or fewer where they would have fewer than LEAST_PART captures)."""
    while (count := runs.count()) > fan_in:
        runs = _longer(folder, runs, count, fan_in)
    last = sorted((r.name, r.n, [tuple(k) for k in r["keys"]]) for r in runs.collect())  # fan_in rows at most
    total = sum(n for _, n, _ in last)
    few = max(spark.sparkContext.defaultParallelism, -(-total // LEAST_PART))
    parts = max(parts or min(int(spark.conf.get("spark.sql.shuffle.partitions")), few), -(-total // PART_ROWS))
    sampled = sorted(((*_sort_key((*k, "", 0))[:4],), n / max(1, len(ks))) for _, n, ks in last for k in ks)
    bounds, seen = [], 0.0
    for k, w in sampled:
        if seen >= total * (len(bounds) + 1) / parts and (not bounds or k > bounds[-1]):
            bounds.append(k)
        seen += w
    names = [n for n, _, _ in last]
    ranges = list(zip([None, *bounds], [*bounds, None], strict=True))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            name, _, _ = _write_run(folder, LoserTree([_entries(folder, x, *ranges[i]) for x in names]), 1 << 62)
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int64()), "name": [name]})

    if not last:
        return []
    return [r.name for r in sorted(one_task_each(spark, ranges).mapInArrow(part, "part long, name string").collect())]


class _Archives:
    """Open archives, the last few used."""

    def __init__(self, folder: str, most: int = 16):
        (self._fs, self._path), self._open, self._most = filesystem(folder), OrderedDict(), most

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self._open.pop(name, None) or self._fs.open_input_file(f"{self._path}/{name}")
        self._open[name] = f
        if len(self._open) > self._most:
            self._open.popitem(last=False)[1].close()
        return f.read_at(length, offset)


_CAPTURE = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("url_key", pa.string()), ("timestamp", pa.string()), ("payload", pa.binary()),
])
_CAPTURE_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, timestamp string"
#: Where an entry stands among all: the number of its part, and its place there.
_PLACE = (("part", pa.int32()), ("place", pa.int64()))
_PLACE_SQL = ", part int, place long"


def _capture(e: tuple, member: bytes, with_payload: bool) -> tuple:
    fields, http, payload = parse(member)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of capture {e[2]} doesn't have its digest")
    page, first = (fields.get(f) for f in ("Page-ID", "Refers-To-Page-ID"))
    return (None if page is None else int(page), int(http["Content-Length"]), digest, fields["WARC-Type"], None if first is None else int(first), e[0], e[1], *([None if revisit else payload] if with_payload else []))


def spans(places: Iterable[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, numbers) of reads that cover sorted places (file, offset, length, number); one longer than READ_BYTES only for a place that is."""
    file, low, high, numbers = "", 0, 0, []
    for f, at, length, i in places:
        if numbers and (f != file or at - high > GAP or max(high, at + length) - low > READ_BYTES):
            yield file, low, high, numbers
            numbers = []
        if not numbers:
            file, low, high = f, at, at
        high = max(high, at + length)
        numbers.append(i)
    if numbers:
        yield file, low, high, numbers


def entries_by_archive(spark: SparkSession, folder: str, index: list[str]) -> DataFrame:
    """The index's entries with ``part`` and ``place``, dealt by ranges of (file, offset) and in that order, for tasks that read TASK_BYTES of records or so."""
    out = pa.schema([*ENTRY, *_PLACE])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            at = 0
            with fs.open_input_file(f"{path}/{index[i]}") as f:
                for b in pq.ParquetFile(f).iter_batches(GROUP_ROWS):
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([i] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], schema=out)
                    at += n

    entries = one_task_each(spark, index).mapInArrow(listed, "url_key string, timestamp string, page_id long, file string, offset long, length long" + _PLACE_SQL)
    n_bytes = entries.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    return entries.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")


def read_archives(spark: SparkSession, folder: str, index: list[str], with_payload: bool = False, in_order: bool = True) -> DataFrame:
    """Captures, with the payloads of responses if asked for; a partition for each part of the index and in its order, or, if not ``in_order``, as they stand in the archives."""
    out = pa.schema([*(_CAPTURE if with_payload else _CAPTURE.remove(7)), *_PLACE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(captures(_Archives(folder), (e for b in batches for e in zip(*(c.to_pylist() for c in b.columns), strict=True))), out)

    def captures(archives: _Archives, entries: Iterator[tuple]) -> Iterator[tuple]:
        held, size = [], 0
        for e in entries:
            held.append(e)
            size += e[5]
            if size >= BATCH_BYTES:
                yield from fetched(archives, held)
                held, size = [], 0
        yield from fetched(archives, held)

    def fetched(archives: _Archives, held: list[tuple]) -> Iterator[tuple]:
        for file, low, high, places in spans((*e[3:6], i) for i, e in enumerate(held)):
            block = archives.read(file, low, high - low)
            for i in places:
                at = held[i][4] - low
                yield *_capture(held[i], block[at : at + held[i][5]], with_payload), *held[i][6:]

    got = entries_by_archive(spark, folder, index).mapInArrow(run, _CAPTURE_SQL + (", payload binary" if with_payload else "") + _PLACE_SQL)
    if in_order and index:
        got = got.repartitionById(len(index), F.col("part")).sortWithinPartitions("place")
    return got.drop("part", "place")


def archive(df: DataFrame, id_col: str, url_col: str, html_col: str, time_col: str | None = None, with_payload: bool = False, fan_in: int = FAN_IN, in_order: bool = True) -> DataFrame:
    """Write all captures, merge their index and read them back, in its order unless told otherwise."""
    spark = df.sparkSession
    folder = new_folder(spark, "captures")
    runs = write_archives(df, id_col, url_col, html_col, folder, time_col)
    return read_archives(spark, folder, merge_runs(spark, folder, runs, fan_in=fan_in), with_payload, in_order)
