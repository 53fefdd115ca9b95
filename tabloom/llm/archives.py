"""Legacy web archives (ARC, versions 1 and 2) to WARC 1.1, and back to rows.

An ARC file opens with a version block whose second line gives the version; each record is one header line, whose
fields depend on that version and whose last field is the declared length, followed by that many bytes. The converter
cuts records by these lengths only, never by searching, and makes for each an equivalent WARC record: identifier,
timestamp, type and digests. Records with equal payloads are stored once: the one with the largest page id as
``response``, the rest as ``revisit`` of it.

Archives are rows (path, content) as Spark's ``binaryFile`` source gives them; WARC files are written by Spark's text
sink (every record is UTF-8 and ends in a line feed, which is that sink's separator), so any store that Spark reaches
will do. A file holds at most what one task writes, and MAX_RECORDS records.

Null html is an empty payload, a null url is written as ``-``; a null page id stays null. Rows that tie in payload and
page id are all ``response``. Empty tables give no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_dir
from .words import slices, text_bytes

ARCHIVE_BYTES = 4_000_000
MAX_RECORDS = 20_000
MIN_REVISIT_BYTES = 0
CAPTURED = "20240102030405"
#: The fields of a record's header line by version.
FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
          2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
              "Filename", "Archive-length"]}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("url string, captured timestamp, mime string, head binary, payload binary, page_id long, payload_bytes long, "
          "payload_digest string, record_id string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC ---

def _arc_block(version: int, name: str) -> bytes:
    body = f"{version} 0 tabloom\n{' '.join(FIELDS[version])}\n".encode()
    extra = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def _arc_record(version: int, page_id, url, payload: bytes) -> bytes:
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    where = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "-"
    extra = f" 200 {sha1_base32(block)} - 0 -" if version == 2 else ""
    return f"{where} 192.0.2.1 {CAPTURED} text/html{extra} {len(block)}\n".encode() + block + b"\n"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        at, _ = text_bytes(batch.column(2))
        for a, b in slices(at, ARCHIVE_BYTES):
            version, name = 1 + number % 2, f"pages-{task:06d}-{number:06d}.arc"
            rows = zip(*[batch.column(i).slice(a, b - a).to_pylist() for i in range(3)], strict=True)
            content = _arc_block(version, name) + b"".join(
                _arc_record(version, i, u, (h or "").encode()) for i, u, h in rows)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])


def arc_archives(pages: DataFrame) -> DataFrame:
    """(path, content): ARC files of a few megabytes, versions 1 and 2 in turn, one record per page."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return rows.mapInArrow(_pack, "path string, content binary")


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields and block of each record after the version block, by the declared lengths."""
    view, at, names = memoryview(content), 0, None
    while at < len(content):
        if content[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        line_end = content.index(b"\n", at)
        parts = content[at:line_end].decode("utf-8", "replace").rstrip("\r").split(" ")
        start = line_end + 1
        end = start + int(parts[-1])
        if end > len(content):
            raise ValueError(f"record at byte {at} declares {parts[-1]} bytes; the archive ends before")
        if names is None:  # the version block says how the other header lines read
            names = FIELDS[int(bytes(view[start:end]).split(None, 1)[0])]
        else:
            # a field such as the url may hold blanks in old files; the others are counted from the right
            spare = len(parts) - len(names)
            yield dict(zip(names, [" ".join(parts[:spare + 1]), *parts[spare + 1:]], strict=True)), view[start:end]
        at = end


_PAGE = re.compile(rb"^X-Page-Id: (-?\d+)\r?$", re.M)
_LENGTH = re.compile(rb"^Content-Length: (\d+)\r?$", re.M)


def _split(block: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (b"", block)


def _read_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(1):
            rows = []
            for fields, block in arc_records(content.as_py()):
                head, payload = _split(bytes(block))
                page, digest, stamp = _PAGE.search(head), sha1_base32(payload), fields["Archive-date"]
                page_id = int(page[1]) if page else None
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {stamp} {page_id} {digest}")
                rows.append((fields["URL"], stamp, fields["Content-type"], head, payload, page_id, len(payload), digest,
                             f"<urn:uuid:{name}>"))
            if not rows:
                continue
            url, stamp, mime, head, payload, page_id, size, digest, name = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(url), pa.array(stamp), pa.array(mime), pa.array(head, pa.binary()), pa.array(payload, pa.binary()),
                 pa.array(page_id, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(name)],
                names=["url", "stamp", "mime", "head", "payload", "page_id", "payload_bytes", "payload_digest", "record_id"])


def read_arc(archives: DataFrame) -> DataFrame:
    return archives.select("path", "content").mapInArrow(_read_arc, RECORD.replace("captured timestamp", "stamp string"))


# --- WARC ---

def decided(records: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds refers_id and refers_record: the record that a revisit refers to, null for a response."""
    key = ["payload_digest", "payload_bytes"]
    first = records.where(F.col("payload_bytes") >= least).groupBy(*key).agg(
        F.max("page_id").alias("top_id"), F.max_by("record_id", "page_id").alias("top_record"))
    both = records.join(first, key, "left")
    other = F.col("top_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top_id")))
    return both.withColumn("refers_record", F.when(other, F.col("top_record"))).drop("top_id", "top_record")


def _warc(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _date(stamp: str) -> str:
    s = stamp.ljust(14, "0")
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    about = b"software: tabloom\r\nformat: WARC File Format 1.1\r\n"
    opening = [_warc("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'warcinfo {task}')}>"),
                                  ("WARC-Date", _date(CAPTURED)), ("Content-Type", "application/warc-fields")], about)]
    for batch in batches:
        out = opening
        for r in batch.to_pylist():
            revisit = r["refers_record"] is not None
            block = r["head"] if revisit else r["head"] + r["payload"]
            fields = [("WARC-Record-ID", r["record_id"]), ("WARC-Date", _date(r["stamp"])), ("WARC-Target-URI", r["url"]),
                      ("Content-Type", "application/http; msgtype=response"),
                      ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
            if revisit:
                fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", r["refers_record"])]
            out.append(_warc("revisit" if revisit else "response", fields, block))
        opening = []
        # The text sink puts a line feed after each value, which is the last byte of a record.
        yield pa.RecordBatch.from_arrays([pa.array([x[:-1].decode() for x in out])], names=["value"])


def write_warc(records: DataFrame, path: str, level: str = "BEST_SPEED") -> None:
    columns = ["url", "stamp", "mime", "head", "payload", "page_id", "payload_digest", "record_id", "refers_record"]
    (records.select(*columns).mapInArrow(_to_warc, "value string").write.option("compression", "gzip")
     .option("zlib.compress.level", level).option("lineSep", "\n").option("maxRecordsPerFile", MAX_RECORDS).text(path))


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record, by the declared lengths. Gzip files of one or many members are read."""
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest) + member.flush())
            rest = member.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        cut = content.index(b"\r\n\r\n", at)
        lines = content[at:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        end = cut + 4 + int(fields["Content-Length"])
        if content[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it declares")
        yield fields, content[cut + 4:end]
        at = end + 4


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in warc_records(content.as_py()):
                kind = fields["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                head, payload = _split(block)
                page, length, digest = _PAGE.search(head), _LENGTH.search(head), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and sha1_base32(payload) != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                rows.append((int(page[1]) if page else None, len(payload) if kind == "response" else int(length[1]), digest,
                             kind, fields.get("WARC-Refers-To"), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *[pa.array(x, pa.string()) for x in c[2:]]],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_record", "record_id", "url", "warc_date"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit of the archives below ``path``; digests of responses are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                        "refers_record string, record_id string, url string, warc_date string")


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """Pages as ARC, converted to WARC files in the shared folder, read back: one row per page."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_warc(decided(read_arc(arc_archives(pages))), path)
    rows = read_warc(spark, path)
    target = (rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_record"))
              .agg(F.max("page_id").alias("refers_to")))
    return rows.join(target, "refers_record", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "warc_date")
