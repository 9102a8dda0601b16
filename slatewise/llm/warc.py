"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole records, and a last skippable frame with the
sizes of all frames (the public seekable format), so that any frame can be read without those before it. The index maps a
record's identifier to bundle, frame and place in the frame.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from slatewise.llm.common import stored, text_bytes
from slatewise.session import work_folder

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Payloads shorter than this are always written whole.
LEAST_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id bigint, record_id string, path string, frame int, frame_offset bigint, frame_bytes bigint, record_offset bigint, record_bytes bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def file_at(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it: a plain path, file:, s3:, gs: or hdfs:."""
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class BundleWriter:
    """Appends records to frames and frames to one file; ``close`` adds the footer and returns the index rows."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES) -> None:
        self.path, self.frame_bytes = path, frame_bytes
        store, name = file_at(path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(name, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frame = bytearray()
        self.waiting: list[tuple[int | None, str, int, int]] = []
        self.sizes: list[tuple[int, int]] = []
        self.rows: list[tuple] = []
        self.written = 0

    def add(self, page_id: int | None, record_id: str, record: bytes) -> None:
        self.waiting.append((page_id, record_id, len(self.frame), len(record)))
        self.frame += record
        if len(self.frame) >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.frame:
            packed = self.packer.compress(bytes(self.frame))
            self.rows += [(p, r, self.path, len(self.sizes), self.written, len(packed), at, size) for p, r, at, size in self.waiting]
            self.sizes.append((len(packed), len(self.frame)))
            self.out.write(packed)
            self.written += len(packed)
            self.frame, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return self.rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of every frame, from the footer of an open bundle."""
    end = file.seek(0, io.SEEK_END) or file.tell()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(end - 9 - count * width)
    table, out, at = file.read(count * width), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    tail = name.strip("<>").rsplit(":", 1)[-1] if name else "none"
    return None if tail == "none" else int(tail)


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of one frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = fields_of(data[at:end])
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_record(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A row of RECORDS. A response's digest is counted anew and must be the one in its header."""
    head, _, payload = block.partition(b"\r\n\r\n")
    stated, length = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields_of(head)["content-length"])
    if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != length):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return page_of(fields["warc-record-id"]), length, stated, fields["warc-type"], page_of(fields.get("warc-refers-to"))


def resolve(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, length and refers_to, the smallest page_id with the same payload of ``least`` bytes or
    more (null for that page itself and for shorter payloads).

    Null html is an empty payload. Rows that repeat the smallest page_id with its payload are all responses; a row without
    page_id revisits a page that has one, and is a response where there is none.
    """
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_bytes("html").alias("payload"))
    read = read.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    first = read.filter(F.col("length") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    joined = read.join(first.filter("copies > 1").drop("copies"), "digest", "left")
    refers = F.when((F.col("length") >= least) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.col("first"))
    out = joined.withColumn("refers_to", refers)
    return out.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "length", "refers_to")


def write_archives(resolved: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the records of every partition into bundles below ``folder`` and return the index, one row per record.

    File names are new for every attempt of a task, and the index names only those of attempts that ended well: a task that
    is repeated leaves at most a file that nothing refers to.
    """
    arrow = to_arrow_schema(resolved.sparkSession.createDataFrame([], INDEX).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        rows: list[tuple] = []
        for batch in batches:
            for page_id, url, payload, digest, length, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if writer is None:
                    writer = BundleWriter(f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", frame_bytes)
                writer.add(page_id, record_name(page_id), write_record(page_id, url, payload, digest, length, refers_to))
                if writer.written >= bundle_bytes:
                    rows += writer.close()
                    writer = None
        if writer is not None:
            rows += writer.close()
        for start in range(0, len(rows), 10_000):
            columns = zip(*rows[start : start + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return stored(resolved.mapInArrow(run, INDEX), "warc-index")


def _read(frames: DataFrame, wanted: bool) -> DataFrame:
    """Rows of RECORDS. ``frames`` has path and, if only some records are ``wanted``, frame places and record places."""
    arrow = to_arrow_schema(frames.sparkSession.createDataFrame([], RECORDS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        for batch in batches:
            for path, *place in zip(*[c.to_pylist() for c in batch.columns]):
                store, name = file_at(path)
                with store.open_input_file(name) as file:
                    if wanted:
                        at, size, begin, length = place
                        file.seek(at)
                        record = unpack(file.read(size))[begin : begin + length]
                        yield emit([read_record(*r) for r in parse_records(record)])
                    else:
                        for at, size, _ in seek_table(file):
                            file.seek(at)
                            yield emit([read_record(*r) for r in parse_records(unpack(file.read(size)))])

    return frames.mapInArrow(run, RECORDS)


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of every bundle in ``index``, frame by frame along the seek tables."""
    paths = index.select("path").distinct()
    tasks = max(1, min(paths.count(), 8 * index.sparkSession.sparkContext.defaultParallelism))
    return _read(paths.repartition(tasks), wanted=False)


def fetch_records(index: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of some ``page_id``s; only their frames are read."""
    places = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    return _read(places.select("path", "frame_offset", "frame_bytes", "record_offset", "record_bytes"), wanted=True)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive all ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or work_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(resolve(pages), folder))
