"""WARC archives: a writer of response and revisit records, and a reader that salvages damaged files.

Writing is done by Spark's text sink, reading by its binary source, so archives can be in any store that Spark
reaches. Of pages with equal payloads of LEAST bytes or more, that with the smallest page_id is a response and
the others revisit it. The reader checks each record's length, block digest and payload digest; where a check
fails it searches for the next version line (in plain files) or gzip member (in .gz files) from which a valid
record follows, and logs the bytes between as a quarantined gap.

A null html counts as empty; a null url has no target URI. Rows with the smallest page_id of a payload are all
responses, and so are rows without a page_id.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Payloads below so many bytes are never revisits. Records in a file at most.
LEAST, RECORDS = 100, 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def firsts(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and refers_to of the pages that revisit another. pages: page_id, digest, size."""
    big = pages.where(F.col("size") >= least)
    shared = big.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return big.join(shared, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One column `value`: each page's record, without the two line ends that close it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    again = written(firsts(rows.select("page_id", "digest", "size"), least), "warc-revisits").withColumnsRenamed({"page_id": "p", "digest": "d"})
    rows = rows.join(again, (rows["page_id"] == again["p"]) & (rows["digest"] == again["d"]), "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    rows = rows.select("page_id", "digest", "refers_to", uri.alias("uri"), block.alias("block"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.col("uri")), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, "block").alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives of pages (page_id, url, html) under path: part-*.txt files of plain WARC 1.1."""
    records(pages, least).write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS).text(path)


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Quarantined bytes."""

    offset: int
    length: int
    reason: str


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


class Damaged(ValueError):
    pass


def _digest_ok(said: str, data: bytes) -> bool:
    kind, _, value = said.partition(":")
    if kind.lower() not in ("sha256", "sha1", "md5"):
        return True  # not a kind that can be checked here
    own = hashlib.new(kind.lower(), data)
    if value.lower() == own.hexdigest():
        return True
    import base64

    return value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def payload_of(record: Record) -> bytes:
    return record.block.partition(END)[2] if record.headers.get("content-type", "").startswith("application/http") else record.block


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at `at`, checked, and where the next one begins."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Damaged("the header doesn't end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        name = name.decode("latin-1").strip().lower()
        if name in headers and name != "warc-concurrent-to":
            raise Damaged("a header twice, as where a record was cut off in its header")
        headers[name] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise Damaged("no length or type")
    begin, end = stop + 4, stop + 4 + int(headers["content-length"])
    if data[end : end + 4] != END:
        raise Damaged("the block isn't as long as its header says")
    record = Record(at, headers, data[begin:end])
    if "warc-block-digest" in headers and not _digest_ok(headers["warc-block-digest"], record.block):
        raise Damaged("block digest")
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers and not _digest_ok(headers["warc-payload-digest"], payload_of(record)):
        raise Damaged("payload digest")
    return record, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at `at` and where it ends."""
    unzip = zlib.decompressobj(31)
    try:
        out = unzip.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise Damaged(f"gzip member: {e}") from None
    if not unzip.eof:
        raise Damaged("the gzip member doesn't end")
    return out, len(data) - len(unzip.unused_data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of a file, and the gaps between them, in order. In .gz files offsets are those of members."""
    member = data[:3] == _MEMBER or (not _VERSION.match(data) and _MEMBER in data and not _VERSION.search(data))
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            if member:
                plain, after = _inflate(data, at)
                found, inner = [], 0
                while inner < len(plain):
                    record, inner = parse(plain, inner)
                    record.offset = at
                    found.append(record)
            else:
                record, after = parse(data, at)
                found = [record]
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            at = data.find(_MEMBER, at + 1) if member else (m.start() if (m := _VERSION.search(data, at + 1)) else -1)
            if at < 0:
                break
            continue
        if bad is not None:
            yield Gap(bad, at - bad, reason)
            bad = None
        yield from found
        at = after
    if bad is not None:
        yield Gap(bad, len(data) - bad, reason)


READ = "path string, offset long, gap_length long, gap_reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _row(path: str, x: Record | Gap) -> dict:
    if isinstance(x, Gap):
        return {"path": path, "offset": x.offset, "gap_length": x.length, "gap_reason": x.reason}
    h, payload = x.headers, payload_of(x)
    size, digest = len(payload), h.get("warc-payload-digest", "").rpartition(":")[2]
    if h["warc-type"] == "revisit":  # the payload is the other record's; the HTTP header has its length
        said = re.search(rb"(?im)^content-length:\s*(\d+)", x.block.partition(END)[0])
        size = int(said[1]) if said else None
    elif not h.get("warc-payload-digest", "").startswith("sha256:"):
        digest = hashlib.sha256(payload).hexdigest()
    names = (("record_type", "warc-type"), ("record_id", "warc-record-id"), ("target_uri", "warc-target-uri"), ("refers_to", "warc-refers-to"))
    return {"path": path, "offset": x.offset, **{k: h.get(v) for k, v in names}, "payload_digest": digest, "payload_bytes": size, "payload": payload}


def _salvaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in READ.split(", ")])
    for batch in batches:
        for i in range(batch.num_rows):
            path, data, held, size = batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), [], 0
            for x in salvage(data):
                held.append(_row(path, x))
                size += len(held[-1].get("payload") or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """READ: a row for each record (gap_length null) and each quarantined gap of the archives under path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvaged, READ)
