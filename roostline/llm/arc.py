"""Converts legacy ARC archives to WARC: version-specific headers in, identifiers, dates, types and digests out."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.llm.common import table
from roostline.session import scratch_dir, staged

# The header fields of the two versions of the ARC format, in their order.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARCHIVE_BYTES = 8 << 20
REVISIT_FROM = 1000


@dataclass
class Record:
    archive: str
    index: int
    url: str
    date: str
    mime: str
    block: bytes

    @property
    def kind(self) -> str:
        """The WARC type that the block calls for, whatever the URL: an HTTP message is a response. Only a version block is warcinfo."""
        if self.index == 0 and self.url.startswith("filedesc:"):
            return "warcinfo"
        return "response" if self.block.startswith(b"HTTP/") else "resource"

    @property
    def record_id(self) -> str:
        """The same for the same place in the same archive, whenever it is converted."""
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{self.archive}#{self.index}')}>"

    def parts(self) -> tuple[bytes, bytes]:
        """HTTP header with its blank line, and payload; a block that is no HTTP message is all payload."""
        if self.kind != "response":
            return b"", self.block
        head, gap, payload = self.block.partition(b"\r\n\r\n")
        return head + gap, payload


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def _opened(content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def read_arc(content: bytes, archive: str) -> Iterator[Record]:
    """Records of an archive after its version block. The block's number says which fields a header line has.

    A URL may hold spaces, so fields are counted from the right. A header that does not fit, or a block
    shorter than declared, is an error that names the archive.
    """
    stream = _opened(content)
    fields: list[str] = FIELDS[1]
    index = 0
    while line := stream.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            continue
        values = text.rsplit(" ", len(fields) - 1)
        if index == 0 and not text.startswith("filedesc:"):
            raise ValueError(f"{archive}: no version block")
        if index == 0:
            values = text.split(" ")
            values = [values[0], values[1], values[2], values[3], values[-1]]
        if len(values) != (len(fields) if index else 5) or not values[-1].isdigit():
            raise ValueError(f"{archive}, record {index}: header {text[:200]!r}")
        block = stream.read(int(values[-1]))
        if len(block) < int(values[-1]):
            raise ValueError(f"{archive}, record {index}: {len(block)} bytes of {values[-1]}")
        if index == 0:
            version = int(block.split(b" ", 1)[0])
            fields = FIELDS.get(version) or block.split(b"\n")[1].decode().split()
        else:
            named = dict(zip(fields, values))
            yield Record(archive, index, named["URL"], named["Archive-date"], named["Content-type"], block)
        index += 1


def arc_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 crawl\n{' '.join(FIELDS[version])}\n".encode()
    fields = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"{fields}{middle} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, url: str, date: str, block: bytes, offset: int) -> bytes:
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"\n{url} 0.0.0.0 {date} text/html{middle} {len(block)}\n".encode() + block


def _page_block(page_id: int | None, html: str | None) -> bytes:
    payload = (html or "").encode()
    who = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{who}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per archive of about 8 MB, versions 1 and 2 in turn."""
    task, number = TaskContext.get().partitionId(), 0
    parts, held = [], 0
    version, name = 1, ""
    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, html = (batch.column(k)[i].as_py() for k in range(3))
            date = (datetime(2008, 1, 1, tzinfo=UTC) + timedelta(seconds=(page_id or 0) % 300_000_000)).strftime("%Y%m%d%H%M%S")
            if not parts:
                version, name = number % 2 + 1, f"crawl-{task:05d}-{number:05d}.arc"
                parts, number = [arc_header(version, name, date)], number + 1
                held = len(parts[0])
            url = "".join((url or "").split()) or f"http://unknown.invalid/{page_id}"
            parts.append(arc_record(version, name, url, date, _page_block(page_id, html), held))
            held += len(parts[-1])
            if held >= ARCHIVE_BYTES:
                yield _one_text(b"".join(parts))
                parts = []
    if parts:
        yield _one_text(b"".join(parts))


def _one_text(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])


def _write(archives: DataFrame, path: str) -> None:
    """Each row (``value``: binary) to a file of its own, compressed, by Spark's own writer."""
    text = archives.select(F.col("value").cast("string"))
    text.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Archive name and content of each file. Archives are small, so several fit a task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def pages_to_arc(pages: DataFrame, path: str) -> None:
    """Lands pages (page_id, url, html) as ARC archives, as a crawl of that time would have."""
    columns = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(columns.mapInArrow(_to_arc, "value BINARY"), path)


EARLIEST = "00010101000000"
SLIM = "record_id STRING, archive STRING, idx INT, page_id BIGINT, payload_bytes BIGINT, sha1 STRING, kind STRING"


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SLIM.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for i in range(batch.num_rows):
            rows = []
            for r in read_arc(batch.column(1)[i].as_py(), batch.column(0)[i].as_py()):
                head, payload = r.parts()
                page = http_field(head, "X-Page-Id")
                rows.append((r.record_id, r.archive, r.index, int(page) if page else None, len(payload), hashlib.sha1(payload).hexdigest(), r.kind))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def references(records: DataFrame) -> DataFrame:
    """Records that revisit another: archive, idx, target (record id).

    Of responses with equal payloads (length and SHA-1) of at least 1,000 bytes the one with the largest page_id
    stays, a null id being the smallest and ties going to the largest record id. The groups are summed up before
    the shuffle; only groups of several take part in the join, and a huge one is a skewed join that AQE splits.
    """
    large = records.where((F.col("payload_bytes") >= REVISIT_FROM) & (F.col("kind") == "response"))
    best = large.groupBy("sha1", "payload_bytes").agg(F.max(F.struct("page_id", "record_id")).alias("b"), F.count("*").alias("n")).where("n > 1")
    joined = large.join(best, ["sha1", "payload_bytes"]).where(F.col("record_id") != F.col("b.record_id"))
    return joined.select("archive", "idx", F.col("b.record_id").alias("target"))


def warc_date(r: Record) -> str:
    """The date of a record, of which any number of digits may be given from the year on; what is missing is the earliest."""
    digits = r.date[:14]
    try:
        return datetime.strptime(digits + EARLIEST[len(digits) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        raise ValueError(f"{r.archive}, record {r.index}: {r.date!r} is no date") from None


def warc_record(r: Record, target: str | None) -> bytes:
    head, payload = r.parts()
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = head if target else r.block
    http = r.kind == "response"
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if target else r.kind}", f"WARC-Record-ID: {r.record_id}", f"WARC-Date: {warc_date(r)}",
             f"WARC-Target-URI: {r.url}", f"WARC-Payload-Digest: {digest}",
             "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()]
    if target:
        lines += [f"WARC-Refers-To: {target}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if http else r.mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_info(archive: str) -> bytes:
    body = f"software: roostline arc converter\r\nformat: WARC File Format 1.0\r\nisPartOf: {archive}\r\n".encode()
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo:{archive}")
    head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Filename: {archive}\r\n"
    return f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One ARC archive with its references to one WARC archive."""
    for batch in batches:
        for i in range(batch.num_rows):
            archive, content, found = (batch.column(k)[i].as_py() for k in range(3))
            targets = {x["idx"]: x["target"] for x in found or ()}
            parts = [warc_info(archive)]
            parts += [warc_record(r, targets.get(r.index)) for r in read_arc(content, archive)]
            yield _one_text(b"".join(parts))


def arc_to_warc(spark: SparkSession, source: str, path: str) -> None:
    """Converts each archive under ``source``: first the digests of all records, then the archives with what they refer to.

    Payloads never leave their archive. What meets in a shuffle is a digest per record, and an archive as a
    file with the list of its revisits, which is no longer than the archive.
    """
    files = _files(spark, source)
    slim = staged(files.mapInArrow(_slim, SLIM), "arc-records")
    lists = references(slim).groupBy("archive").agg(F.collect_list(F.struct("idx", "target")).alias("refs"))
    _write(files.join(lists, "archive", "left").select("archive", "content", "refs").mapInArrow(_convert, "value BINARY"), path)


def read_warc(content: bytes, archive: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    stream = _opened(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: {line[:80]!r} where a record should begin")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{archive}, {fields.get('warc-record-id')}: {len(block)} bytes of {length}")
        yield fields, block


READ = "record_id STRING, record_type STRING, page_id BIGINT, payload_bytes BIGINT, payload_digest STRING, target STRING"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in READ.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for i in range(batch.num_rows):
            rows = []
            for fields, block in read_warc(batch.column(1)[i].as_py(), batch.column(0)[i].as_py()):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                page, stated = http_field(head, "X-Page-Id"), base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                if kind == "revisit":
                    size = int(http_field(head, "Content-Length"))
                else:
                    payload = payload if kind == "response" else block
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if digest != stated:
                        raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                rows.append((fields["warc-record-id"], kind, int(page) if page else None, size, stated, fields.get("warc-refers-to")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record but warcinfo: record_id, record_type, page_id, payload_bytes, payload_digest, target."""
    return _files(spark, path).mapInArrow(_read, READ)


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC archives say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null or blank url gets a stand-in, any other url is taken as it is without its blanks, repeated rows get a record each; an empty table
    gives no rows.
    """
    spark = pages.sparkSession
    arcs, warcs = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    pages_to_arc(pages, arcs)
    arc_to_warc(spark, arcs, warcs)
    read = staged(warc_records(spark, warcs), "warc-records")
    ids = read.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    plain = read.where("target IS NULL").withColumn("refers_to", F.lit(None).cast("bigint"))
    revisits = read.where("target IS NOT NULL").join(ids, "target", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*columns).unionByName(revisits.select(*columns))


def op5_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    return pages_through_archives(table(spark, folder, "pages"))


OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY n, d) AS best FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {REVISIT_FROM} AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_FROM} AND page_id <> best THEN best END AS refers_to
FROM g
"""
