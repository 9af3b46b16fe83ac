"""WARC archives with revisit records: write deduplicated, read back.

Headers (never payloads) are grouped by payload digest to find each payload's response; the others revisit it. Which pages revisit is
joined to the pages once, and that is the only shuffle that payloads ride through, those of revisits too, since only the join tells.
Archives go through Spark's text sink as whole-file gzip: a record is one value, the record separator is the sink's line separator, so
that commit, retry and any Hadoop file system come with the sink and no executor needs a folder of its own (one gzip member a record,
which would let readers seek, is beyond that sink). An archive holds as many records as fit its size at their mean length, however
large the partition is that it is written from. Archives are read as binary files; a response's payload must match its digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._shared import shared_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreservesf.org/warc/1.0/revisit/identical-payload-digest"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """``min_revisit_bytes``: smaller payloads are never revisits; ``archive_bytes``: payload of an archive, about."""

    min_revisit_bytes: int = 0
    archive_bytes: int = 64 << 20
    date: str = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """SHA-1 of binary data in upper-case base32: 15 hexadecimal digits are 12 of base 32, which an unsigned 64-bit number holds.

    The digest is bound by ``transform``, so that it is computed once however often the parts name it."""

    def text(digest: Column) -> Column:
        part = lambda at, n, width: F.lpad(F.conv(F.substring(digest, at, n), 16, 32), width, "0")
        return F.translate(F.concat(part(1, 15, 12), part(16, 15, 12), part(31, 10, 8)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)

    return F.transform(F.array(F.sha1(data)), text)[0]


def resolve_revisits(headers: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, payload_digest, refers_to of the pages that revisit another; from page_id, payload_digest, payload_bytes of all.

    Of equal payloads the largest page_id is the response. Each digest is aggregated first (map-side combined), then only digests
    with several pages are joined back to their pages, so a digest of any number of pages is never gathered."""
    able = headers.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    shared = able.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    return able.join(shared.select("payload_digest", "refers_to"), "payload_digest").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("none"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, how: Archive = Archive()) -> None:  # noqa: B008
    """Write one record per row of ``pages`` (page_id, url, html) under ``path``, with fresh headers.

    The payload is the html in UTF-8, empty where it is null; a null url gives no target URI. A row without page_id is always a
    response. Rows that share a page_id are records of their own and never revisit each other. Other columns are ignored; an empty
    table gives archives without records."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", " ").alias("url"), body.alias("body"))
    rows = rows.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("payload_digest", base32_sha1(F.col("body").cast("binary")))
    links = resolve_revisits(rows.select("page_id", "payload_digest", "payload_bytes"), how.min_revisit_bytes)
    dealt = rows.join(links, ["page_id", "payload_digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    fields = [
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(how.date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block.cast("binary")))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        line("WARC-Refers-To-Page", F.col("refers_to").cast("string")),
        line("WARC-Page", F.col("page_id").cast("string")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.lit(f"WARC/1.0{CRLF}"), *fields, F.lit(CRLF), block)
    mean = pages.agg(F.avg(F.octet_length(body))).collect()[0][0] or 0.0
    most = max(1, int(how.archive_bytes / (mean + 1024)))
    dealt.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive, gzipped (in one member or one per record) or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        head = data.find(b"\r\n\r\n", at)
        if head < 0:
            raise ValueError("a record's header has no end")
        headers = {}
        for one in data[at:head].split(b"\r\n")[1:]:
            name, _, value = one.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        length = int(headers["content-length"])
        block = data[head + 4 : head + 4 + length]
        if len(block) < length:
            raise ValueError("a record's block is cut short")
        yield headers, block
        at = head + 4 + length


_READ = "record_type string, record_id string, target_uri string, payload_digest string, refers_to_id string, page_id long, refers_to long, payload_bytes long, payload binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-page", "warc-refers-to-page", "warc-payload-length")

    def frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["record_type", "record_id", "target_uri", "payload_digest", "refers_to_id", "page_id", "refers_to", "payload_bytes", "payload"])
        return made.astype({x: "Int64" for x in ("page_id", "refers_to", "payload_bytes")})

    for files in batches:
        for content in files["content"]:
            out, size = [], 0
            for h, block in parse_records(bytes(content)):
                payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                digest = h.get("warc-payload-digest")
                if h.get("warc-type") == "response" and (digest or "").startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
                    raise ValueError(f"the payload of {h.get('warc-record-id')} does not match its digest")
                whole = [None if (v := h.get(n)) is None else int(v) for n in names[5:]]
                if whole[2] is None and h.get("warc-type") != "revisit":
                    whole[2] = len(payload)
                out.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), h.get("warc-refers-to"), *whole, payload))
                size += len(payload)
                if size > 4 << 20:
                    yield frame(out)
                    out, size = [], 0
            yield frame(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``. A revisit's payload is empty; an archive without records has no rows."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_read, _READ)


def archive_round_trip(pages: DataFrame, how: Archive = Archive()) -> DataFrame:  # noqa: B008
    """Write ``pages`` into a fresh folder of the shared one and read the archives back: one row per record."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, how)
    return read_archives(spark, path)
