"""WARC archives in which repeated payloads are revisit records of one original response.

Only headers (id, digest, size) are shuffled by payload digest.  The largest id of a digest is the response;
the others learn it by a join, and the archives are written with fresh headers in the pages' own
partitions, so payloads are never shuffled unless the list of revisits is too long to broadcast.  Archives
are ordinary WARC/1.1 files: the text writer puts each record and the closing blank lines, byte for byte.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small, stage

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 4000
#: Payload bytes of an archive; pages are written by classes of size, from each class's upper bound to its records in a file.
FILE_BYTES, CLASS_BYTES = 64 << 20, (16 << 10, 256 << 10, 4 << 20, 64 << 20)
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four of base 32."""
    h = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers``: page_id, payload_digest, payload_bytes -> page_id, payload_digest, refers_to of the revisits."""
    own = headers.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = stage(own.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low"), "originals")
    return own.join(first, "payload_digest").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if i > 1 else ()) + (F.substring(h, i, n),)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for null; line ends in a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, revisits: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record for each page, without the closing blank lines, in column ``value``."""
    body = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("payload_digest", payload_digest(F.col("body"))).withColumn("payload_bytes", F.octet_length("body"))
    rows = rows.join(small(revisits), ["page_id", "payload_digest"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END)).cast("binary")
    block = F.concat(http, F.when(again, F.lit(b"")).otherwise(F.col("body")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("WARC-Refers-To", F.when(again, _urn(F.col("refers_to"), F.col("payload_digest")))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Refers-To-Page-Id", F.col("refers_to")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, classes: Sequence[int] = CLASS_BYTES) -> None:
    """Write deduplicated archives below ``path``, of at most ``records_per_file`` records and about ``file_bytes`` payload bytes.

    Pages go by classes of size: those of up to ``classes[i]`` bytes, so many to a file that they can't exceed it; larger ones than
    all classes have files of their own.  A class without pages, but the first, is not written.
    """
    body = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    headers = stage(pages.select(pages["page_id"].cast("long").alias("page_id"), payload_digest(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes")), "headers")
    revisits = stage(resolve(headers, min_bytes), "revisits")
    size = F.octet_length(body)
    of = lambda n: sum((F.when(n > bound, 1).otherwise(0) for bound in classes), F.lit(0))
    for i in sorted({0, *(r[0] for r in headers.select(of(F.col("payload_bytes")).alias("c")).distinct().collect())}):
        count = max(1, min(records_per_file, file_bytes // classes[i])) if i < len(classes) else 1
        records(pages.where(of(size) == i), revisits, date).write.option("lineSep", END).option("maxRecordsPerFile", count).text(f"{path}/class-{i}")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, by the lengths that the records state."""
    at = 0
    while at < len(data):
        start = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : start - 4].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        end = start + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[start:end]
        at = end + 4


def _rows(data: bytes) -> Iterator[tuple]:
    for fields, block in parse(data):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
        number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
        yield number("X-Page-Id"), fields.get("WARC-Target-URI"), size, digest, kind, number("X-Refers-To-Page-Id"), payload if kind == "response" else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits), digests verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for data in b.column(0):
                rows = []
                for row in _rows(data.as_buffer().to_pybytes()):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("content").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back: a row for each row.

    A null html is an empty payload.  Of equal payloads of at least ``min_bytes`` bytes, the rows with
    the largest page_id are responses, the others revisit it.  Rows without page_id are responses that
    none refers to; rows that repeat the largest id are all responses.  A null url has no header line.  An
    empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)
