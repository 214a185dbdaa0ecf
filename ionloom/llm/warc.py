"""WARC archives of captures and their merged index.

Records (WARC/1.1, one HTTP response each, gzip files of at most `FILE_RECORDS` records) are written
by Spark's committer to shared storage, so a lost executor leaves nothing half done. A payload of at
least `MIN_REVISIT` bytes is stored once, under the largest page id; equal payloads become revisit
records that name it. The largest id per payload is a partial aggregate, and the join back is on the
digest, so a payload held by many pages is not gathered.

Reading parses the archives by their length headers and gives one index line per record. The index
is merged externally: each archive's lines, sorted where they are read, are a run; runs are dealt by
ranges of (URL key, time), and each range merges its runs with a tree of losers, holding one line per
run at a time above the dealt lines. Ranges are ordered, so (bucket, rank) is the order of all
captures, with each URL's history in one piece; a URL with very many captures spans several ranges.

Defined cases: null html is an empty payload; a null url has the empty key and no target header; line
breaks in urls are percent-encoded; equal rows are separate records, and all rows with the largest
id of a payload are responses; a null id is below all others, and payloads with null ids only are all
responses; captures carry no time in the table, so the time is `EPOCH` plus the id in seconds (null: 0).
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import os
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.session import new_path, stage

MIN_REVISIT = 1000
#: Records of an archive; pages of more than `FILE_BYTES` / `FILE_RECORDS` bytes share it with fewer.
FILE_RECORDS = 4096
FILE_BYTES = 1 << 27
INDEX_ROWS = 100_000
EPOCH = "2024-01-01 00:00:00"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = (
    "surt string, stamp string, page_id bigint, archive string, offset bigint, length bigint, payload_bytes bigint, "
    "payload_digest string, record_type string, refers_to bigint"
)
ARROW = pa.schema([
    (c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in INDEX.split(", ")
])


def _header(name: str, value: Column) -> Column:
    """One header line, empty for null."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def _uuid(*columns: str) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, refers_url)"""
    html = F.coalesce(F.col("html"), F.lit(""))
    captured = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"),
    )
    large = captured.filter(F.col("payload_bytes") >= MIN_REVISIT)
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count("*").alias("n"))
    first = first.select("payload_digest", "payload_bytes", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"), "n")
    first = stage(first.filter((F.col("n") > 1) & F.col("original").isNotNull()).drop("n"), "originals")
    joined = captured.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"),
        F.when(revisit, F.col("original_url")).alias("refers_url"),
    )


def capture_time(page_id: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce(page_id, F.lit(0)))


def record_text(captured: DataFrame) -> DataFrame:
    """(value): the whole record without its closing blank lines."""
    stamp = capture_time(F.col("page_id"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(HTTP), "html")).otherwise(F.lit(HTTP))
    head = F.concat(
        F.lit("WARC/1.1"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _uuid("page_id", "url", "payload_digest")),
        _header("WARC-Date", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("X-Page-Id", F.col("page_id").cast("string")),
        _header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _header("X-Refers-To-Page", F.col("refers_to").cast("string")),
        _header("WARC-Refers-To", F.when(~response, _uuid("refers_to", "refers_url", "payload_digest"))),
        _header("WARC-Refers-To-Date", F.when(~response, F.date_format(capture_time(F.col("refers_to")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return captured.select(F.concat(head, block).alias("value"))


def size_class() -> Column:
    """Number of doublings by which a page is above the usual share of an archive."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("payload_bytes"), F.lit(1)) * F.lit(FILE_RECORDS / FILE_BYTES)))).cast("int")


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of at most `FILE_RECORDS` records and, up to one record, `FILE_BYTES` bytes before packing.

    Writers count records only, so pages are written by size class, larger ones with fewer records a file.
    """
    captured = records(pages)
    sizes = pages.select(F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("payload_bytes"))
    classes = sorted(r["c"] for r in sizes.select(size_class().alias("c")).distinct().collect())
    for c in classes or [0]:
        out = record_text(captured.filter(size_class() == c)).write.mode("append").option("lineSep", END).option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, FILE_RECORDS >> c)).text(path)


def surt(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then the path and query; scheme, port and fragment dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    labels = [x for x in host.split(".") if x]
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + query


def parse_archive(name: str, content: bytes) -> Iterator[tuple]:
    """Index tuples of an uncompressed archive, in file order."""
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"{name}: no record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        size = int(head["Content-Length"])
        block = memoryview(content)[head_end + 4 : head_end + 4 + size]
        if len(block) != size:
            raise ValueError(f"{name}: the record at {at} is cut off")
        kind, digest, length = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        if kind == "response":
            payload = block[len(HTTP) :]
            digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
        yield (
            surt(head.get("WARC-Target-URI")), head["WARC-Date"], None if page is None else int(page), name, at, size,
            length, digest, kind, None if refers is None else int(refers),
        )
        at = head_end + 4 + size + len(END)


def order(row: tuple) -> tuple:
    """URL key, time, id (null first), archive, offset."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of all archives, a sorted run per archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                content = gzip.decompress(content.as_py())
                rows = sorted(parse_archive(os.path.basename(name.as_py()), content), key=order)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return files.mapInArrow(run, INDEX)


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, so a step replays one path."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads: list[tuple | None] = [self._next(i) for i in range(len(runs))]
        self.tree = [0] * max(1, len(runs))
        self.tree[0] = self._build(1)

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (order(row), row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and (a[0], i) < (b[0], j))

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        winner, self.tree[node] = (left, right) if self._beats(left, right) else (right, left)
        return winner

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.heads[winner := self.tree[0]] is not None:
            yield self.heads[winner][1]
            self.heads[winner] = self._next(winner)
            node = (winner + k) // 2
            while node:
                if self._beats(self.tree[node], winner):
                    winner, self.tree[node] = self.tree[node], winner
                node //= 2
            self.tree[0] = winner


def merge_index(runs: DataFrame) -> DataFrame:
    """The index in global order: rows with `bucket` (range) and `rank` within it."""
    schema = ARROW.append(pa.field("bucket", pa.int64())).append(pa.field("rank", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dealt.setdefault(row[3], []).append(row)
        for rows in dealt.values():
            rows.sort(key=order)  # already in order where the shuffle kept a run's order
        bucket, held, rank = TaskContext.get().partitionId(), [], 0
        for row in LoserTree(list(dealt.values())):
            held.append((*row, bucket, rank))
            rank += 1
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema=schema)

    # As many ranges as hold about `INDEX_ROWS` rows each: a task's runs are held in memory while they are merged.
    ranges = runs.count() // INDEX_ROWS + 1
    ranged = runs.repartitionByRange(ranges, "surt", "stamp", "page_id", "archive", "offset")
    return ranged.mapInArrow(run, INDEX + ", bucket bigint, rank bigint")


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives (to `path`, or a new shared folder), read them back and merge their index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    return merge_index(stage(read_index(spark, path), "runs"))
