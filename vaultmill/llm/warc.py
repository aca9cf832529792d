"""WARC archives with revisit records.

Writing: every page's payload (its html in UTF-8) has a SHA-256. Only headers - id, digest, size -
are shuffled by digest; of equal payloads of at least ``LEAST`` bytes the smallest id becomes the
response and the others become revisit records without payload that name it. A digest with very
many pages is met by a broadcast of at most ``HUBS`` rows, so it is in no single task. The list of
revisits then meets the payloads: by broadcast up to ``FEW`` of them, so that payloads stay where they
are read, by a join on id and digest beyond that, which no hot payload skews. Records get fresh headers
(the date of writing, their own ids, length, digest) and are compressed singly, a gzip member for
each, so that any record can be read from its offset. Members are gathered to archives of about
``ROOM`` bytes, each opened by a warcinfo record, and go out through Spark's own writer: a row is a
file, task commits survive lost executors and any Hadoop file system will do. The writer ends a row
with a separator; that is the zero byte which ends a gzip member of less than 16 MB (an empty member
is added after a larger one), taken off the row before.

Reading: each archive is unpacked as a stream and cut by Content-Length, never by searching for
separators, so payloads may hold anything. Payload digests are checked against the headers, and
revisit records are joined to their responses for size and digest.

Ids are whole numbers (others raise a TypeError). Null html: an empty payload. Null url: no target URI.
Null ids: come last, and have no id header. A record is held whole, an archive is not longer than
``ROOM`` and one record.
Rows that repeat id and payload of a response are responses too. Empty input: empty output.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultmill.llm.common import HUBS, LEAF, cut, forget, integer_id, row_id, shared_dir, star, table

LEAST = 100
ROOM, FEW = 32 << 20, 200_000  # bytes of an archive; revisits that are broadcast, of about 100 bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat(page.cast("string"), F.lit(":"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def resolve(pages: DataFrame) -> DataFrame:
    """pages(rid, digest, bytes, ..) -> (rid, digest, first): first is the response's id."""
    heads = cut(pages.where(F.col("bytes") >= LEAST).select(F.col("digest").alias("u"), F.col("rid").alias("v")).distinct())
    met = star(heads, max(LEAF, heads.count() // HUBS)).where("m < v")
    return cut(met.select(F.col("v").alias("rid"), F.col("u").alias("digest"), F.col("m").alias("first")))


def member(record: bytes) -> bytes:
    """A gzip member whose last byte is zero."""
    out = gzip.compress(record, 6, mtime=0)
    return out if not out[-1] else out + gzip.compress(b"", 6, mtime=0)


def archives(date: str, room: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        row = lambda: pa.record_batch([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
        for b in batches:
            for r in b.column(0).cast(pa.large_binary()):
                if size >= room:
                    yield row()
                    held, size = [], 0
                record = r.as_py()
                if not held:
                    fields = b"software: vaultmill\r\nformat: WARC File Format 1.1\r\n"
                    name = uuid.UUID(bytes=hashlib.md5(date.encode() + record).digest())
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}{END}"
                    held.append(member(head.encode() + fields + END.encode()))
                held.append(member(record))
                size += len(held[-1])
        if held:
            yield row()

    return pack


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None, room: int = ROOM) -> None:
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(pages[f"`{payload_col}`"].cast("string"), F.lit(""))
    i = integer_id(pages, id_col)
    p = pages.select(i.cast("string").alias("pid"), row_id(i).alias("rid"), pages[f"`{url_col}`"].cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    revisits = resolve(p)
    if revisits.count() <= FEW:
        revisits = F.broadcast(revisits)
    p = p.join(revisits, ["rid", "digest"], "left")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("rid"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("first"), F.col("digest")))),
        F.when(revisit, line("WARC-Refers-To-Date", F.lit(date))),
        line("X-Page-ID", F.col("pid")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    out = p.withColumn("block", block).select(F.concat(head, F.lit(END), F.col("block"), F.lit(END)).cast("binary").alias("value"))
    out = out.mapInArrow(archives(date, room), "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {first[:40]!r}")
        head: dict[str, str] = {}
        while (raw := stream.readline()) not in (b"\r\n", b""):
            name, _, value = raw.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or stream.read(4) != END.encode():
            raise ValueError("a record is cut short")
        yield head, block


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            rows = []
            for head, block in records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())))):
                if head["warc-type"] == "warcinfo":
                    continue
                payload = block.partition(END.encode())[2]
                claimed = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != claimed:
                    raise ValueError(f"the payload of {head['warc-record-id']} does not have its digest")
                page = head.get("x-page-id")
                rows.append((None if page is None else int(page), head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), claimed, len(payload)))
                if len(rows) == 4096:
                    yield batch(rows)
                    rows = []
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    cols = zip(*rows) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "kind", "record", "target", "digest", "bytes"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    r = cut(raw.mapInArrow(parse, "page_id long, kind string, record string, target string, digest string, bytes long"))
    plain = r.where("kind = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    full = r.where("kind = 'response'").groupBy(F.col("record").alias("target"), "digest").agg(F.max("bytes").alias("payload_bytes"), F.min("page_id").alias("refers_to"))
    again = r.where("kind = 'revisit'").select("page_id", "target", "digest", "kind").join(full, ["target", "digest"], "left")
    checked = F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response for "), "target")).cast("long"))
    return plain.unionByName(again.select("page_id", checked.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    out = read_archives(spark, path)  # the records' headers are written out by now
    forget(spark, path)
    return out


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
