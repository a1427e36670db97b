"""Legacy web archives: ARC records of versions 1 and 2 become equivalent WARC 1.1 records.

An ARC file begins with a version block (``filedesc://``) whose second line gives the version and whose third
names the fields of every later header line. A header line's last field declares how many bytes follow.
The converter reads by those declared lengths and makes what ARC lacks: record identifiers, ISO
timestamps, record types and digests. Payloads seen before become revisits that refer to the first. The
version block becomes a warcinfo record, and what only version 2 says of a document goes into ARC- headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import sharedfs
from gneiss.session import cut, shared_folder, ship

#: Fixed values of the formats: header fields by version, the WARC profile of revisits.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always responses.
LEAST_PAYLOAD = 0
FIRST_DAY = datetime(2000, 1, 1, tzinfo=timezone.utc)
#: The upper 48 bits of the identifiers that are made here.
NAMESPACE = int.from_bytes(b"gneiss", "big")


@dataclass
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    more: dict[str, str]

    @property
    def payload_at(self) -> int:
        """Where the payload begins in the block: after the HTTP head, if there is one."""
        if self.block[:5] == b"HTTP/":
            found = re.search(rb"\r?\n\r?\n", self.block)
            return found.end() if found else len(self.block)
        return 0


@dataclass
class VersionBlock:
    name: str
    date: str
    version: int
    body: bytes


def arc_header(version: int, name: str = "pages.arc", when: str = "20000101000000") -> bytes:
    """A version block."""
    body = f"{version} {0} gneiss\n{' '.join(FIELDS[version])}\n\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {when} text/plain {len(body)}\n", 2: f"filedesc://{name} 0.0.0.0 {when} text/plain 200 - - 0 {name} {len(body)}\n"}[version]
    return line.encode() + body


def arc_record(version: int, url: str, date: str, block: bytes, content_type: str = "text/html", ip: str = "0.0.0.0", offset: int = 0, name: str = "pages.arc") -> bytes:
    """One document of an ARC file, with the line end that follows it."""
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} {ip} {date} {content_type}{middle} {len(block)}\n".encode() + block + b"\n"


def parse_arc(f: io.BufferedIOBase) -> Iterator[VersionBlock | ArcRecord]:
    """The version block of an open ARC file and then its documents. Raises ValueError on what is no ARC.

    Header lines are split from the right, by the fields of the file's version, so that a URL may hold
    spaces. Lengths decide where a document ends, so its bytes may look like anything.
    """
    line = f.readline()
    if not line.startswith(b"filedesc://"):
        raise ValueError("no version block")
    body = f.read(int(line.rsplit(b" ", 1)[1]))
    lines = body.split(b"\n")
    version = int(lines[0].split(b" ", 1)[0])
    names = lines[1].decode("utf-8", "replace").split() if len(lines) > 1 and lines[1].strip() else list(FIELDS[version])
    cells = line.decode("utf-8", "replace").split(" ")
    yield VersionBlock(cells[0].removeprefix("filedesc://"), cells[2] if len(cells) > 2 else "", version, body)
    while line := f.readline():
        if not line.strip():
            continue  # line ends between documents
        cells = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(cells) != len(names):
            raise ValueError(f"a header line of version {version} has {len(names)} fields")
        got = dict(zip(names, cells))
        size = int(got["Archive-length"])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("the file ends within a document")
        yield ArcRecord(version, got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], block, {k: v for k, v in got.items() if k not in FIELDS[1]})


def iso_date(date: str) -> str:
    """ARC's 14 digits (or fewer, which mean the beginning of the time they name) as a WARC date."""
    d = (date + "00000101000000"[len(date) :]) if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(number: int | None) -> str:
    """A version-8 UUID that holds a 64-bit number; or, for None, says that there is none."""
    n = (number or 0) & (2**64 - 1)
    flags = (1 << 11 if number is None else 0) | n >> 62
    return f"urn:uuid:{uuid.UUID(int=NAMESPACE << 80 | 8 << 76 | flags << 64 | 2 << 62 | n & (2**62 - 1))}"


def number_of(record: str) -> int | None:
    """The number in an identifier of ``record_id``."""
    x = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if x >> 64 & (1 << 11):
        return None
    n = (x >> 64 & 3) << 62 | x & (2**62 - 1)
    return n - 2**64 if n >= 2**63 else n


def digest(data: bytes | memoryview) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, rid: str, date: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": date, **headers, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(record: ArcRecord, rid: str, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC document: a response, or a revisit of the record ``refers_to``."""
    payload_at = record.payload_at
    headers = {"WARC-Target-URI": record.url, "WARC-IP-Address": record.ip, "WARC-Payload-Digest": f"sha1:{digest(memoryview(record.block)[payload_at:])}"}
    http = record.block[:5] == b"HTTP/"
    headers["Content-Type"] = "application/http;msgtype=response" if http else record.content_type
    headers |= {f"ARC-{k}": v for k, v in record.more.items() if v not in ("", "-")}
    block = record.block
    if refers_to is not None:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>", "WARC-Truncated": "length"}
        headers["WARC-Identified-Payload-Type"] = record.content_type
        block = block[:payload_at]
    return warc_record("response" if refers_to is None else "revisit", rid, iso_date(record.date), headers, block)


def convert_info(block: VersionBlock, rid: str) -> bytes:
    """The warcinfo record of a version block."""
    said = f"software: gneiss\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {block.version}\r\n".encode()
    return warc_record("warcinfo", rid, iso_date(block.date), {"WARC-Filename": block.name, "Content-Type": "application/warc-fields"}, said)


def read_warc(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an open WARC file."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, f.read(int(head["content-length"]))


def page_block(html: bytes) -> bytes:
    """The HTTP response that a page was, as far as it can be known."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a WARC record for each row of ``pages`` (page_id, url, html); the manifest (path, n_records, n_bytes).

    Each batch is first laid out as an ARC file, of version 1 or 2, and converted from there. Null html
    counts as empty, and an empty payload is a payload like any other; a null url is ``-``. Rows that
    share both payload and smallest page_id are all responses. Null ids are never the smallest unless all are.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("-")).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first")).withColumnRenamed("sha", "sha2")
    rows = rows.join(first, F.col("sha") == F.col("sha2")).select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n = TaskContext.get(), None, 0
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids, firsts = part.column("page_id").to_pylist(), part.column("first").to_pylist()
                version = 1 + (at // 200 + n) % 2
                legacy = io.BytesIO()
                legacy.write(arc_header(version))
                for page, url, body in zip(ids, part.column("url").to_pylist(), part.column("html").to_pylist()):
                    when = FIRST_DAY + timedelta(seconds=(page or 0) % (20 * 365 * 86400))
                    legacy.write(arc_record(version, re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url), f"{when:%Y%m%d%H%M%S}", page_block(body), offset=legacy.tell()))
                legacy.seek(0)
                found = parse_arc(legacy)
                info = next(found)
                if out is None:
                    out = sharedfs.create(path)
                    out.write(gzip.compress(convert_info(info, f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}"), 3, mtime=0))
                for record, page, one in zip(found, ids, firsts, strict=True):
                    short = len(record.block) - record.payload_at < LEAST_PAYLOAD
                    again = not short and page != one
                    out.write(gzip.compress(convert(record, record_id(page), record_id(one) if again else None), 3, mtime=0))
                    n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "n_bytes": size}])

    return cut(rows.mapInArrow(run, "path string, n_records long, n_bytes long"))


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the manifest's files, from the files alone.

    A response's payload is hashed anew and must have the digest that its header gives.
    """
    spark = manifest.sparkSession
    paths = sorted((r.path,) for r in manifest.select("path").collect())  # a row a file
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with sharedfs.open_file(path) as raw, gzip.GzipFile(fileobj=raw) as f:
                    rows = []
                    for head, block in read_warc(f):
                        if head["warc-type"] == "warcinfo":
                            continue
                        at = ArcRecord(0, "", "", "", "", block, {}).payload_at
                        said = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response":
                            size = len(block) - at
                            if digest(memoryview(block)[at:]) != said:
                                raise ValueError(f"damaged payload of {head['warc-record-id']} in {path}")
                        else:
                            size = int(re.search(rb"(?im)^content-length: *(\d+)", block[:at])[1])
                        rows.append((number_of(head["warc-record-id"]), size, said, head["warc-type"], number_of(head["warc-refers-to"]) if "warc-refers-to" in head else None))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return spark.createDataFrame(paths, "path string").repartition(max(1, len(paths))).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_and_read(pages: DataFrame) -> DataFrame:
    """The records of new archives in the shared folder, as read back from them."""
    return read(write(pages, shared_folder(pages.sparkSession, "warc")))


#: The same in DuckDB, over the view ``pages``: base32 is made of the hash's groups of five bits.
QUERY_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS one, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(x, CAST(i AS INTEGER), 1)) - 3, 4)), '') AS bits FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda k: CAST(substr(bits, CAST(5 * i + k AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 5 - k) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = one THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = one THEN NULL ELSE one END AS refers_to
FROM b
"""
