"""Legacy archive converter: ARC files (versions 1 and 2) become WARC 1.1 files.

An ARC file starts with a version block that names its version and fields; every record is a header
line of these fields, the last of which declares the length of what follows. The converter reads
records by their declared lengths, never by searching the content, and makes for each the WARC
identifier (a name-based UUID of file and offset, so that a repeated task writes the same), the ISO
timestamp, the record type (version block: warcinfo; HTTP message: response; anything else: resource)
and SHA-1 digests of block and payload in base32. Of records with equal payloads the one with the
largest page number is a full response, the others are revisits that keep only the HTTP header and
refer to it.

Reading and parsing run per file inside tasks; equal payloads meet by an aggregation on the digest
with a partial step and one join on the digest, which adaptive execution splits for a very common
payload. Files are written by Spark's text writer (gzip, a bounded number of records per file), so
any store that Spark reaches will do, and read back with its binary file source.

A null html is an empty payload, a null address is written "-", blanks and control characters in an
address are percent-encoded. A page without a number has no X-Page-Id; it loses every tie. Equal rows
are records of their own: one is the response. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.store import materialise, new_path

#: The header fields of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORDS_PER_FILE = 1000
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_FILE = "path string, content binary"
_RECORD = (
    "path string, offset long, kind string, page_id long, url string, date string, content_type string, "
    "head binary, payload binary, payload_bytes long, payload_digest string"
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, url: bytes, ip: str, date: str, kind: str, offset: int, name: str, body: bytes) -> bytes:
    front = url + f" {ip} {date} {kind} ".encode()
    if version == 2:
        front += f"200 {digest(body)} - {offset} {name} ".encode()
    return front + f"{len(body)}\n".encode()


def arc_file(records: Iterable[tuple[str | None, int | None, str | None]], version: int, name: str, date: str = "20240101000000") -> bytes:
    """An ARC file of (url, page_id, html) records in the given version."""
    about = f"{version} 0 pagelake\n{FIELDS[version]}\n".encode()
    front = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    out = bytearray(front.encode() + (b"200 - - 0 " + name.encode() + b" " if version == 2 else b"") + f"{len(about)}\n".encode() + about)
    for url, page, html in records:
        payload = (html or "").encode("utf-8", "surrogatepass")
        number = f"X-Page-Id: {page}\r\n" if page is not None else ""
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        address = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url or "-").encode("utf-8", "surrogatepass")) or b"-"
        out += b"\n" + arc_header(version, address, "0.0.0.0", date, "text/html", len(out) + 1, name, body) + body
    return bytes(out + b"\n")


def as_arc(pages: DataFrame, records: int = 200) -> DataFrame:
    """Pages packed into ARC files (path, content) of both versions in turn, like a binary file source."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made_here = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, records):
                made_here += 1
                rows = list(zip(*(batch.column(c).slice(a, records).to_pylist() for c in ("url", "page_id", "html"))))
                name = f"pages-{task:06d}-{made_here:06d}.arc"
                made = arc_file(rows, 1 + made_here % 2, name)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([made], pa.binary())], ["path", "content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, _FILE)


def arc_records(content: bytes, path: str = "") -> Iterator[tuple[int, dict[str, bytes], bytes]]:
    """Offset, header fields and body of each record; the version block comes first."""
    at, names = 0, None
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].rstrip(b"\r")
        if names is None:  # the header line of the version block has the fields that its body names
            body_at = end + 1
            version = int(content[body_at : body_at + 8].split(None, 1)[0])
            names = FIELDS[version].split()
        values = line.rsplit(b" ", len(names) - 1)  # old files have addresses with blanks
        if len(values) != len(names) or not values[-1].isdigit() or end + 1 + int(values[-1]) > len(content):
            raise ValueError(f"{path}: no record of its declared length at byte {at}")
        size = int(values[-1])
        yield at, dict(zip(names, values)), content[end + 1 : end + 1 + size]
        at = end + 1 + size


def warc_date(date: str) -> str:
    """ISO timestamp of an ARC date of 4 to 14 digits."""
    full = date + "00000101000000"[len(date) :] if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _page_number(head: bytes) -> int | None:
    found = re.search(rb"(?im)^x-page-id: *(-?\d+)\r?$", head)
    return int(found[1]) if found else None


def parse_arc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per ARC record of (path, content) files, the version blocks left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string())
        names = [c.split()[0] for c in _RECORD.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, raw = [], content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                for offset, field, body in islice(arc_records(raw, path.as_py()), 1, None):  # after the version block
                    http = body.startswith(b"HTTP/")
                    cut = body.find(b"\r\n\r\n") + 4 if http else 0
                    head, payload = (body[:cut], body[cut:]) if cut >= 4 else (b"", body)
                    rows.append((
                        path.as_py(), offset, "response" if head else "resource", _page_number(head), field["URL"].decode("utf-8", "replace"),
                        warc_date(field["Archive-date"].decode("ascii", "replace")), field["Content-type"].decode("utf-8", "replace"),
                        head, payload if with_payload else None, len(payload), digest(payload),
                    ))
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return files.select("path", "content").mapInArrow(run, _RECORD)


def record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}>"


def warc_record(headers: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def to_warc(files: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Column record (binary): the WARC records of ARC files, in tasks that each start with a warcinfo record."""
    firsts = (
        materialise(parse_arc(files, with_payload=False).filter(F.col("payload_bytes") >= least_bytes).select("page_id", "path", "offset", "url", "payload_digest"), "arcindex")
        .groupBy("payload_digest")
        .agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "path", "offset", "url")).alias("first"))
    )
    roles = parse_arc(files).join(firsts, "payload_digest", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for batch in batches:
            out: list[bytes] = []
            for r in batch.to_pylist():
                if not started:
                    about = b"software: pagelake\r\nformat: WARC File Format 1.1\r\n"
                    out.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(r["path"], -1 - r["offset"])), ("WARC-Date", r["date"]), ("Content-Type", "application/warc-fields")], about))
                    started = True
                first = r["first"] if r["payload_bytes"] >= least_bytes else None
                again = first is not None and (first["path"], first["offset"]) != (r["path"], r["offset"])
                block = r["head"] + (b"" if again else r["payload"])
                kind = "application/http; msgtype=response" if r["head"] else r["content_type"]
                out.append(warc_record([
                    ("WARC-Type", "revisit" if again else r["kind"]),
                    ("WARC-Record-ID", record_id(r["path"], r["offset"])),
                    ("WARC-Date", r["date"]),
                    ("WARC-Target-URI", r["url"]),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None),
                    ("WARC-Refers-To", record_id(first["path"], first["offset"]) if again else None),
                    ("WARC-Refers-To-Target-URI", first["url"] if again else None),
                    ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                    ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                    ("X-Payload-Length", str(r["payload_bytes"]) if again else None),
                    ("Content-Type", kind),
                ], block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return roles.mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzip-compressed WARC files; the writer's line end is the last byte of a record."""
    value = F.expr("substring(record, 1, octet_length(record) - 1)").cast("string")
    records.select(value.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def warc_records(content: bytes, path: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(content):
        cut = content.find(b"\r\n\r\n", at)
        lines = content[at:cut].decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers.get("Content-Length", -1))
        after = cut + 4 + size
        if cut < 0 or not lines[0].startswith("WARC/1.") or size < 0 or content[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"{path}: no WARC record of its declared length at byte {at}")
        yield headers, content[cut + 4 : after]
        at = after + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, record_id and refers_to_id of a WARC folder.

    The payload's digest and length are computed again and must be those of the header.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "record_id", "refers_to_id"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for h, block in warc_records(gzip.decompress(content.as_py()), name.as_py()):
                    kind = h["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    cut = block.find(b"\r\n\r\n") + 4 if h["Content-Type"].startswith("application/http") else 0
                    stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(h["X-Payload-Length"]) if kind == "revisit" else len(block) - cut
                    if kind != "revisit" and digest(block[cut:]) != stated:
                        raise ValueError(f"{name}: {h['WARC-Record-ID']} has another payload than its digest")
                    rows.append((_page_number(block[:cut]), h["WARC-Target-URI"], kind, size, stated, h["WARC-Record-ID"], h.get("WARC-Refers-To")))
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, record_id string, refers_to_id string")


def convert(files: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Convert ARC files, write the WARC files to the shared folder and read them back.

    refers_to is the page number of the response that a revisit points to.
    """
    path = new_path(files.sparkSession, "warc")
    write_warc(to_warc(files, least_bytes), path)
    read = read_warc(files.sparkSession, path)
    pointed = read.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return read.join(pointed, "refers_to_id", "left").drop("refers_to_id")
