"""Media columns: archives of media files as a Spark data source, read by byte ranges and retried member by member.

An archive is a ZIP file of stored members. The source plans partitions from names and sizes alone: byte ranges of archive
files. A partition reads the archive's directory, takes the members whose header begins in its range, and streams their
bytes in Arrow batches of bounded size. A member that cannot be read is tried again from its own offset, alone; if that
keeps failing, its row says so and the others are not touched.

The media here are texts as PNG images, 192 samples of 8 bits a row, from which features are computed after reading back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared_files import listing, put, task_number

WIDTH = 192
#: Bytes of an archive, of a byte range and of an Arrow batch, about; a larger member goes whole.
ARCHIVE, RANGE, BATCH = 16 << 20, 8 << 20, 8 << 20
TRIES, LEVEL = 3, 4
PNG = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes) -> bytes:
    """raw with spaces up to a positive multiple of WIDTH bytes."""
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def encode(raw: bytes) -> bytes:
    """A grey 8-bit PNG of the padded bytes; a text chunk keeps their number before padding."""
    samples = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # filter type 0 before each row
    rows[:, 1:] = samples
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", header) + chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """The samples, one row of WIDTH each, and the number of bytes before padding, of an image that encode() made."""
    at, body, n = len(PNG), [], 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged chunk")
        if kind == b"tEXt":
            n = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:], n


def difference_hash(samples: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 grid of mean brightness is darker than its right neighbour."""
    h = len(samples)
    bands = [(i * h // 8, max(i * h // 8 + 1, (i + 1) * h // 8)) for i in range(8)]
    rows = np.array([samples[a:b].sum(axis=0, dtype=np.int64) // (b - a) for a, b in bands])
    edges = np.arange(9) * WIDTH // 9
    cells = np.add.reduceat(rows, edges, axis=1) // np.diff(np.append(edges, WIDTH))
    return f"{int(''.join('1' if x else '0' for x in (cells[:, :-1] < cells[:, 1:]).ravel()), 2):016x}"


def archiver(folder: str, size: int = ARCHIVE):
    """(id, text) to one row an archive that it writes: (archive, members, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, members, total = task_number(), 0, 0, 0
        buffer = io.BytesIO()
        out = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        def close() -> pa.RecordBatch:
            out.close()
            name, data = f"media-{task:06d}-{done:05d}.zip", buffer.getvalue()
            put(folder, name, data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([members], pa.int64()), pa.array([len(data)], pa.int64())], ["archive", "members", "bytes"])

        for b in batches:
            for ident, text in zip(b.column(0), b.column(1), strict=True):
                media = encode((text.as_py() or "").encode())
                out.writestr(zipfile.ZipInfo(f"{'null' if ident.as_py() is None else ident.as_py()}/{members}.png"), media)
                members, total = members + 1, total + len(media)
                if total >= size:
                    yield close()
                    done, members, total, buffer = done + 1, 0, 0, io.BytesIO()
                    out = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
        if members:
            yield close()

    return run


def read_at(store: fs.FileSystem, path: str, offset: int, size: int, crc: int) -> bytes:
    """The bytes of the stored member whose local header begins at offset."""
    with store.open_input_file(path) as f:
        head = f.read_at(30, offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member there")
        name, extra = struct.unpack("<HH", head[26:30])
        data = f.read_at(size, offset + 30 + name + extra)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("damaged")
    return bytes(data)


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range, self.batch = options["path"], int(options.get("rangebytes", RANGE)), int(options.get("batchbytes", BATCH))

    def partitions(self) -> list[ByteRange]:
        found = [ByteRange(path, at, min(size, at + self.range)) for path, size in listing(self.folder) for at in range(0, size, self.range)]
        return found or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        if partition.path:
            store = fs.FileSystem.from_uri(self.folder)[0]
            with store.open_input_file(partition.path) as f:
                members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.end]
            for m in members:
                media, error = None, None
                for _ in range(TRIES):
                    try:
                        media, error = read_at(store, partition.path, m.header_offset, m.file_size, m.CRC), None
                        break
                    except (OSError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append((partition.path, m.header_offset, m.filename, media, error))
                held += m.file_size
                if held >= self.batch:
                    yield self.rows(rows)
                    rows, held = [], 0
        yield self.rows(rows)

    def rows(self, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["archive", "offset", "member", "media", "error"])


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder); options rangeBytes and batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(folder)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes each row's text as a member of an archive in folder, ids in the members' names; gives the number of members."""
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(archiver(folder), "archive string, members long, bytes long")
    return made.agg(F.sum("members")).first()[0] or 0


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, media) to what was asked of it."""
    for b in batches:
        rows = []
        for member, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            samples, n = decode(media)
            payload = samples.tobytes()
            ident = member.partition("/")[0]
            rows.append((None if ident == "null" else int(ident), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(samples)))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], FEATURES)


FEATURES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_features(docs: DataFrame, folder: str) -> DataFrame:
    """One row for each row of docs: its text as an image, written to archives in folder, read back and measured.

    Null texts count as empty, one row of spaces. Null ids come back as null, repeated rows as often as they are there. An
    empty table writes nothing and gives no rows. Other columns are ignored. A member that stays unreadable is an error.
    """
    write_archives(docs, folder)
    media = read_archives(docs.sparkSession, folder)
    sound = media.select("member", F.when(F.col("error").isNull(), F.col("media")).otherwise(F.raise_error(F.concat("archive", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "error"))).alias("media"))
    return sound.mapInArrow(features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
