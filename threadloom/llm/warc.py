"""WARC: converts legacy ARC archives, and reads what it wrote.

An ARC file opens with a filedesc record whose body names the version (1 or 2) and the header fields; every record is a
header line with a declared length and that many bytes. The converter reads both versions, and gives each record what WARC
asks for: an identifier, a timestamp, a type, block and payload digests. Records whose payload was seen before become
revisits of the one with the least page id.

Files are compressed record by record. All work is dealt by archive; what crosses tasks is a digest, a number and a place
for each record, never a payload.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared_files import listing, put, task_number

#: Compressed bytes of an archive, about; a larger record goes whole.
ARCHIVE, LEVEL = 4 << 20, 1
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
NAMESPACE = uuid.UUID("6f1c2a52-0d7b-4c1e-9a55-3a1d0c9d7e10")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def packed(record: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, wbits=31)
    return c.compress(record) + c.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each compressed record."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out, end = zlib.decompressobj(31), [], at
        while not d.eof and end < len(view):
            out.append(d.decompress(view[end : end + 16384]))
            end = min(end + 16384, len(view))
        yield at, b"".join(out)
        at = end - len(d.unused_data)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_writer(folder: str, date: str, size: int = ARCHIVE):
    """(page_id, url, html) to one row an ARC file: (archive, records). Files of odd tasks are version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, records, parts, total = task_number(), 0, 0, [], 0
        version = 1 + task % 2

        def name() -> str:
            return f"pages-{task:06d}-{done:05d}.arc.gz"

        def line(url: str, mime: str, at: int, n: int) -> bytes:
            extra = f"200 - - {at} {name()} " if version == 2 else ""
            return f"{url} 0.0.0.0 {date} {mime} {extra}{n}\n".encode()

        def opening() -> bytes:
            body = f"{version} 0 threadloom\n{V2 if version == 2 else V1}\n".encode()
            return packed(line(f"filedesc://{name()}", "text/plain", 0, len(body)) + body + b"\n")

        def close() -> pa.RecordBatch:
            put(folder, name(), b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([name()]), pa.array([records], pa.int64())], ["archive", "records"])

        for b in batches:
            for page, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not parts:
                    parts = [opening()]
                    total = len(parts[0])
                payload = (html or "").encode()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
                block = head.encode() + payload
                where = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "unknown:"
                parts.append(packed(line(where, "text/html", total, len(block)) + block + b"\n"))
                records, total = records + 1, total + len(parts[-1])
                if total >= size:
                    yield close()
                    done, records, parts = done + 1, 0, []
        if parts:
            yield close()

    return run


def arc_records(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, filedesc first, as dicts of their header fields, with offset and block."""
    fields: list[str] = []
    for offset, record in members(data):
        line, _, rest = record.lstrip(b"\n").partition(b"\n")
        parts = line.decode("utf-8", "replace").split(" ")
        n = int(parts[-1])
        block = rest[:n]
        if len(block) != n:
            raise ValueError(f"record at {offset} is shorter than declared")
        if parts[0].startswith("filedesc:"):
            version, names = block.decode().split("\n")[:2]
            fields = names.split(" ")
            if version.split(" ")[0] not in "12" or fields != (V1 if version[0] == "1" else V2).split(" "):
                raise ValueError(f"unknown ARC version line {version!r}")
        if not fields or len(parts) != len(fields):
            raise ValueError(f"record at {offset} has {len(parts)} fields")
        yield dict(zip(fields, parts, strict=True)) | {"offset": offset, "block": block}


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with its empty line, and payload; a block without a header is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def page_of(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of ARC files to (path, offset, page_id, digest, n) of their web records."""
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            rows = []
            for r in arc_records(content.as_py()):
                if r["URL"].startswith("filedesc:"):
                    continue
                head, payload = http_parts(r["block"])
                rows.append((path.as_py(), r["offset"], page_of(head), digest(payload), len(payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "offset", "page_id", "digest", "n"])


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}@{offset}')}>"


def warc_record(archive: str, r: dict, first: dict | None) -> bytes:
    """The WARC record of an ARC record; first: page_id, archive and offset of the one it revisits."""
    date = r["Archive-date"].ljust(14, "0")
    head, payload = http_parts(r["block"])
    kind, mime, block = "response", "application/http; msgtype=response", r["block"]
    if r["URL"].startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
        block = f"software: threadloom\r\nformat: WARC File Format 1.1\r\nconverted-from: {archive}\r\n".encode()
    elif not head:
        kind, mime = "resource", r["Content-type"]
    elif first is not None:
        kind, block = "revisit", head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(archive, r['offset'])}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z", f"Content-Type: {mime}", f"Content-Length: {len(block)}", f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {r['URL']}", f"WARC-IP-Address: {r['IP-address']}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first['archive'], first['offset'])}"] + ([f"X-Refers-To-Page-Id: {first['page_id']}"] if first["page_id"] is not None else [])
    return packed("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n")


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def converter(folder: str):
    """(path, content, again) to (archive, records): again lists, by offset, the records that revisit another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, again in zip(b.column(0), b.column(1), b.column(2), strict=True):
                archive = base_name(path.as_py())
                first = {x["offset"]: x["first"] | {"archive": base_name(x["first"]["archive"])} for x in again.as_py() or ()}
                out = [warc_record(archive, r, first.get(r["offset"])) for r in arc_records(content.as_py())]
                put(folder, archive.replace(".arc.gz", ".warc.gz"), b"".join(out))
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([len(out)], pa.int64())], ["archive", "records"])

    return run


def warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content of WARC files to the rows of read_warcs()."""
    for b in batches:
        for content in b.column(0):
            rows = []
            for _, record in members(content.as_py()):
                head, _, rest = record.partition(b"\r\n\r\n")
                named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                block = rest[: int(named["Content-Length"])]
                if digest(block) != named["WARC-Block-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"{named['WARC-Record-ID']} is damaged")
                if named["WARC-Type"] == "warcinfo":
                    continue
                http, payload = http_parts(block)
                revisit = named["WARC-Type"] == "revisit"
                said = re.search(rb"\r\nContent-Length: (\d+)\r\n", http)
                refers = named.get("X-Refers-To-Page-Id")
                rows.append((
                    page_of(http), int(said[1]) if revisit and said else len(payload), named["WARC-Payload-Digest"].removeprefix("sha1:"), named["WARC-Type"], int(refers) if refers else None,
                    named["WARC-Target-URI"], named["WARC-Date"], named["WARC-Record-ID"], None if revisit else payload,
                ))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ROW)


ROW = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "date", "record_id", "payload"]


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    if not listing(folder):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")


def write_arcs(pages: DataFrame, folder: str, date: str = "20240101000000") -> int:
    """Writes pages (page_id, url, html) as ARC files; gives the number of records."""
    return pages.select("page_id", "url", "html").mapInArrow(arc_writer(folder, date), "archive string, records long").agg(F.sum("records")).first()[0] or 0


def convert_arcs(spark: SparkSession, arcs: str, warcs: str, least: int = 0) -> int:
    """Converts the ARC files of one folder to WARC files in another; payloads of at least `least` bytes that occurred before
    become revisits. Gives the number of records, warcinfo included."""
    files = _files(spark, arcs, "*.arc.gz")
    found = files.mapInArrow(payloads, "path string, offset long, page_id long, digest string, n long")
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.col("path").alias("archive"), "offset")
    firsts = found.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    again = found.join(firsts, ["digest", "n"]).filter((F.col("path") != F.col("first.archive")) | (F.col("offset") != F.col("first.offset")))
    again = again.groupBy("path").agg(F.collect_list(F.struct("offset", F.struct(F.col("first.page_id"), F.col("first.archive"), F.col("first.offset")).alias("first"))).alias("again"))
    return files.join(again, "path", "left").mapInArrow(converter(warcs), "archive string, records long").agg(F.sum("records")).first()[0] or 0


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, date, record_id, payload) of every record but warcinfo."""
    return _files(spark, folder, "*.warc.gz").select("content").mapInArrow(warc_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, date string, record_id string, payload binary")


def archived_pages(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each row of pages, through ARC and WARC files.

    Null html is an empty payload, a null url `unknown:`. Of equal payloads the record with the least page id is the
    response, null ids last, the first stored of repeated ids; refers_to is null where that has no id. Empty tables give no
    rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    write_arcs(pages, f"{folder}/arc")
    convert_arcs(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warcs(spark, f"{folder}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH h AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
x AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM h),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(('0x' || hex[i])::INT), 4)), 'string_agg', '') AS bits FROM x),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (list_sum(list_transform(range(1, 6), lambda j: bits[5 * i + j]::INT * (1 << (5 - j)::INT))))::INT + 1, 1)), 'string_agg', '') AS payload_digest FROM bits),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
