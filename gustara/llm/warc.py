"""WARC archives of pages, and one capture index merged from the archives' sorted runs.

Writing: one record per page into part files of bounded size. Equal payloads are stored once: the
record of the largest page id keeps the payload, the others are revisits that name it. Reading: each
archive gives a run of captures sorted by URL key and time; runs are cut at common key ranges and
each range is merged from its k run slices by a loser tree, so the ranges in order are the whole
capture history.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustara.operators.skew import attach
from gustara.session import materialize, work_dir

REVISIT_BYTES = 1000
# Largest payload and records per file of each size class: files stay near 32 MB, one record above.
SIZE_CLASSES = ((16 << 10, 2048), (256 << 10, 128), (4 << 20, 8), (None, 1))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "run string, url_key string, captured string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, offset bigint, record_bytes bigint, intact boolean"
)
INDEX_ARROW = pa.schema(
    [
        ("run", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()),
        ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("offset", pa.int64()), ("record_bytes", pa.int64()), ("intact", pa.bool_()),
    ]
)


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    captured: str | None = None, revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write one WARC/1.1 record per row of ``pages`` below ``path``, a new folder.

    The payload is the UTF-8 of ``html`` (NULL: empty). Among equal payloads of at least
    ``revisit_bytes`` the rows with the largest id are responses, all others revisits of it; a NULL id
    counts as smallest, and rows that all lack an id are all responses. ``captured`` names a timestamp
    column; without one (or where NULL) the record date is the epoch plus the id in seconds, so
    captures keep the order of ids. Control characters and blanks in a URL are written as %XX; a NULL
    URL is written as an empty one. The files are named by Spark's text writer.
    """
    identity = F.col(page_id).cast("bigint")
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    when = F.timestamp_seconds(F.coalesce(identity, F.lit(0)))
    when = when if captured is None else F.coalesce(F.col(captured).cast("timestamp"), when)
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    for sign in (" ", "\t", "\r", "\n"):
        address = F.replace(address, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    rows = pages.select(identity.alias("id"), address.alias("url"), when.alias("at"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    known = materialize(rows.select("id", "size", "sha"), "payloads")
    same = known.where(F.col("size") >= revisit_bytes).groupBy("sha", "size").agg(F.max("id").alias("kept"), F.count("*").alias("n"))
    marked = attach(rows, same.where("n > 1").drop("n"), ["sha", "size"], "left")
    again = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("id"))
    records = marked.withColumn("refers", F.when(again, F.col("kept"))).select("size", record_text().alias("value"))
    largest = known.agg(F.max("size")).first()[0]
    low = -1
    for high, count in SIZE_CLASSES:
        # The first class is always written, so that the folder exists for an empty table too.
        if low < 0 or (largest or 0) > low:
            part = records.where((F.col("size") > low) & (F.lit(True) if high is None else F.col("size") <= high))
            part.select("value").write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", count).text(path)
        low = high


def record_uri(identity: F.Column) -> F.Column:
    """A record id derived from the page id, so that revisits can name a record not yet written."""
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(identity.cast("string"), F.lit("null"))).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def record_text() -> F.Column:
    """One record without the empty lines behind it, which the text writer adds."""
    again = F.col("refers").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n")
    )
    block = F.concat(head, F.when(again, F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), record_uri(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size")),
        F.concat(F.lit("X-Page-ID: "), F.col("id")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_uri(F.col("refers")))),
        F.when(again, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the right, then port, path and query."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def parse_records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, named fields and block of every record, by the declared lengths."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        stop = end + 4 + int(fields["Content-Length"])
        yield at, stop + 4 - at, fields, view[end + 4 : stop]
        at = stop + 4


def read_run(run: str, archive: bytes) -> list[tuple]:
    """The captures of one archive as a run sorted by URL key, time and page id."""
    rows = []
    for offset, size, fields, block in parse_records(archive):
        block = bytes(block)
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        intact = kind == "revisit" or hashlib.sha1(payload).hexdigest() == digest
        refers, identity = fields.get("X-Refers-To-Page-ID"), fields.get("X-Page-ID")
        rows.append(
            (
                run, url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], None if identity is None else int(identity),
                fields["WARC-Target-URI"], kind, None if refers is None else int(refers), int(fields["X-Payload-Length"]),
                digest, offset, size, intact,
            )
        )
    return sorted(rows, key=order_of)


def order_of(row: tuple) -> tuple:
    return row[1], row[2], row[3] is not None, row[3] or 0


class LoserTree:
    """Merges k sorted runs; each inner node holds the run that lost there, so one path is replayed a row."""

    def __init__(self, runs: list[list[tuple]]):
        self.heads = [iter(r) for r in runs]
        self.rows = [next(h, None) for h in self.heads]
        self.keys = [None if r is None else order_of(r) for r in self.rows]
        self.losers = [0] * max(1, len(runs))
        # Below inner node n lie nodes 2n and 2n + 1; the runs are the nodes from k on.
        winners = [0] * len(runs) + list(range(len(runs)))
        for node in range(len(runs) - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.best = winners[1] if len(runs) > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; ended runs go last, equal rows by run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self) -> Iterator[tuple]:
        while self.rows and self.rows[self.best] is not None:
            run = self.best
            yield self.rows[run]
            self.rows[run] = next(self.heads[run], None)
            self.keys[run] = None if self.rows[run] is None else order_of(self.rows[run])
            node = (run + len(self.rows)) // 2
            while node:
                if self._first(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.best = run


def to_batches(rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield _batch(part)
            part = []
    if part:
        yield _batch(part)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives below ``path``, each archive as one sorted run."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from to_batches(iter(read_run(name.as_py(), content.as_py())))

    return files.mapInArrow(parse, INDEX)


def merge_index(runs: DataFrame) -> DataFrame:
    """Captures in global order of URL key, time and page id (NULL first), merged from sorted runs.

    The ranges are cut by all three keys, so a URL or host with a third of all captures is spread too.
    Merging holds the index rows of one range, never payloads.
    """
    keys = ["url_key", "captured", "page_id"]
    ranges = runs.repartitionByRange(*keys).sortWithinPartitions("run", *keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slices.setdefault(row[0], []).append(row)
        # The engine sorts text by bytes as Python does by code points; ids put NULL first in both.
        yield from to_batches(iter(LoserTree(list(slices.values()))))

    return ranges.mapInArrow(merge, INDEX)


def archive_pages(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives (to a new folder in the shared one unless ``path`` is given), read
    them back and give their merged capture index, one row per page."""
    spark = pages.sparkSession
    path = path or f"{work_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **columns)
    return merge_index(materialize(read_archives(spark, path), "captures"))
