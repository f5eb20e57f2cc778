"""WARC archives and their capture index.

Pages are written as WARC/1.1 records through Spark's own writer, equal payloads as revisits of one response. Reading gives each archive's
captures as a run sorted by URL key and time; the runs are dealt out by ranges of (key, time, page), Spark sorts each range by run, on disk where it must,
and a loser tree merges the slices of all runs, which wait as Arrow batches. The rows then are in one order over all partitions: the capture
history of every URL.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.rows import tidy

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, seq int"
INDEX = RUN.replace(", seq int", "") + ", part int, at long"


def utc_stamp(seconds: Column) -> Column:
    """Seconds since 1970 as a WARC date. Days and times of day are told apart by division, so that no session's time zone takes part."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86400).cast("int")).cast("string")
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    of_day = F.pmod(seconds, F.lit(86400))
    return F.concat(day, F.lit("T"), two(F.floor(of_day / 3600)), F.lit(":"), two(F.floor(of_day / 60) % 60), F.lit(":"), two(of_day % 60), F.lit("Z"))


def record_text(page: Column, url: Column, seconds: Column, payload: Column, digest: Column, first: Column) -> Column:
    """A whole record but for the last line end, which the writer sets."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.when(first.isNull(), F.concat(head, payload)).otherwise(head)
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn(page)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "%0A")), F.lit("")),
        line("WARC-Date", utc_stamp(seconds)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(first.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", urn(first)))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", epoch: int = 1_704_067_200, least: int = 100, archive_bytes: int = 64 << 20) -> None:
    """A record per row, in gzipped archives of about `archive_bytes` unpacked at most; a larger record has one alone.

    Of the rows with equal payloads of at least `least` bytes, those with the smallest key are responses and the others revisit it; a null
    key is never the smallest unless all are null. A null payload is empty, a null url gives no target. A page's date is `epoch` plus its key.
    """
    payload = F.coalesce(pages[html].cast("string"), F.lit(""))
    rows = pages.select(pages[key].cast("long").alias("page"), pages[url].cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(pages[html].cast("string")), F.lit(0)) + 600)).first()[0] or 1
    large = F.octet_length("payload") >= least
    firsts = rows.where(large).groupBy("digest").agg(F.min("page").alias("first")).select(F.col("digest").alias("group"), "first")
    group = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page", "digest").cast("string")))
    told = rows.withColumn("group", group).join(firsts, "group", "left")
    first = F.when(F.col("page").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    seconds = F.lit(epoch) + F.pmod(F.coalesce("page", F.lit(0)), F.lit(1_000_000_000))
    record = record_text(F.col("page"), F.col("url"), seconds, F.col("payload"), F.col("digest"), first)
    told.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)


def url_key(url: str | None) -> str:
    """A URL's sort key: host labels from the last to the first, port, then path and sorted query; no scheme, `www` or fragment."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.strip().lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/').lower()}" + (f"?{query.lower()}" if query else "")


def records(archive: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset in the unpacked archive, headers and block of each record; lengths alone say where a record ends."""
    with gzip.GzipFile(fileobj=io.BytesIO(archive)) as f:
        while version := f.readline():
            at = f.tell() - len(version)
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no record at {at}")
            headers = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[name.lower()] = value
            block = f.read(size := int(headers["content-length"]))
            if len(block) != size or f.read(4) != b"\r\n\r\n":
                raise ValueError(f"the record at {at} is cut off")
            yield at, headers, block


def _page(urn: str | None) -> int | None:
    return int(n) if urn and (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None


def capture(archive: str, at: int, headers: dict[str, str], block: bytes) -> tuple:
    """A row of the index; a response's payload must have the digest and length that its headers give."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{archive}: the payload at {at} isn't what was written")
    stamp = "".join(c for c in headers["warc-date"] if c.isdigit())
    return url_key(headers.get("warc-target-uri")), stamp, _page(headers["warc-record-id"]), length, digest, headers["warc-type"], _page(headers.get("warc-refers-to")), archive, at


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Reads all archives below path; each gives a run sorted by URL key, time and page."""
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in RUN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = name.as_py().rpartition("/")[2]
                rows = sorted((capture(archive, *r) for r in records(content.as_py())), key=order)
                for i in range(0, len(rows), 10_000):
                    part = [(*row, i + k) for k, row in enumerate(rows[i : i + 10_000])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, RUN)


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The rows of sorted runs in one order. Inner nodes hold the loser of each match, so a step replays one path to the root; of each run one row is held.

    Equal rows come in the order of their runs; a run without rows never wins, and no runs give no rows.
    """
    k = len(runs)
    if not k:
        return
    last = (True,)
    runs = [iter(run) for run in runs]
    rows = [next(run, None) for run in runs]
    heads = [last if row is None else (False, order(row), i) for i, row in enumerate(rows)]
    losers = [-1] * k

    def replay(i: int) -> int:
        node = (i + k) // 2
        while node:
            held = losers[node]
            if held < 0:
                losers[node] = i
                return -1
            if heads[held] < heads[i]:
                losers[node], i = i, held
            node //= 2
        return i

    winner = 0
    for i in range(k):
        found = replay(i)
        winner = found if found >= 0 else winner
    while heads[winner] != last:
        yield rows[winner]
        row = rows[winner] = next(runs[winner], None)
        heads[winner] = last if row is None else (False, order(row), winner)
        winner = replay(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in one order over (part, at): by URL key, then time, then page; a null page comes before others, repeated rows by archive and offset.

    Ranges are cut by key, time, page and place, so that the captures of a URL with very many go to several tasks. No runs give no rows.
    """
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in INDEX.split(", ")])

    def lazily(batches: list[pa.RecordBatch], step: int = 512) -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield from zip(*(c.to_pylist() for c in batch.slice(i, step).columns), strict=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        slices: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:  # each run's rows come together and in its order
            names = batch.column(7).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                slices.setdefault(names[a], []).append(batch.slice(a, b - a))
        part, held = TaskContext.get().partitionId(), []
        for at, row in enumerate(loser_tree([lazily(s) for s in slices.values()])):
            held.append((*row[:9], part, at))
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    dealt = runs.repartitionByRange("url_key", "captured_at", F.col("page_id").asc_nulls_first(), "archive", "offset")
    return dealt.sortWithinPartitions("archive", "seq").mapInArrow(merge, INDEX)


def positions(index: DataFrame) -> DataFrame:
    """A written index with each capture's `position` in the one order of all, from 0; what meets in a window is one count for each partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(F.broadcast(bases), "part").withColumn("position", F.col("base") + F.col("at")).drop("base")
