"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames, a frame can be unpacked without the others. A bundle
ends with a seek table in a skippable frame (the public seekable format: sizes of every frame,
then their number and a magic number), so any reader of Zstandard can read it through, and a
reader that knows the table can jump. The index says for each record which frame of which bundle
holds it and where it begins in the unpacked frame.

Bundles go to a folder that driver and executors share. A task gives every bundle a name of its
own and returns the index rows; Spark commits the rows of one attempt of each task only, so
bundles of lost or repeated attempts are in no index.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import salted_lookup, scratch, table, written
from rollcall.llm.registry import query

#: Unpacked bytes after which a frame, and a bundle, is closed. A longer record has its own frame.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
LEAST_REVISIT = 100
#: Frames that a task reads back, on average.
FRAMES_READ = 64
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "record_id string, bundle string, frame int, frame_start bigint, frame_size bigint, "
    "offset bigint, length bigint"
)
RECORD = (
    "record_id string, page_id bigint, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, payload binary"
)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    return int(digits) if (digits := identifier.removeprefix("<urn:x-page:").removesuffix(">")) else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response, or (with ``first``) a revisit of that page, whose HTTP head is kept."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if first is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # White space and control characters would break the header apart.
        safe = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    if first is not None:
        lines += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The record at the beginning of ``data``; its payload must match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) : len(block) + 4] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} does not end where it should")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (
        hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(stated["Content-Length"])
    ):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what was written")
    refers = fields.get("WARC-Refers-To")
    return {
        "record_id": fields["WARC-Record-ID"],
        "page_id": page_of(fields["WARC-Record-ID"]),
        "record_type": kind,
        "payload_bytes": int(stated["Content-Length"]),
        "payload_digest": digest,
        "refers_to": page_of(refers) if refers else None,
        "payload": payload if kind == "response" else None,
    }


class Bundle:
    """Writes frames one after another; nothing but the open frame is held."""

    def __init__(self, folder: str):
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        # The bundle packs its frames itself; the name must not make the stream pack them again.
        self.out = files.open_output_stream(f"{path}/{self.name.rpartition('/')[2]}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.open: list[tuple[str, bytes]] = []
        self.open_size = self.position = self.unpacked = 0

    def add(self, identifier: str, data: bytes) -> Iterator[tuple]:
        self.open.append((identifier, data))
        self.open_size += len(data)
        if self.open_size >= FRAME_BYTES:
            yield from self.end_frame()

    def end_frame(self) -> Iterator[tuple]:
        """Pack the open frame; the index rows of its records."""
        if not self.open:
            return
        packed = self.packer.compress(b"".join(x for _, x in self.open))
        self.out.write(packed)
        offset = 0
        for identifier, data in self.open:
            yield identifier, self.name, len(self.frames), self.position, len(packed), offset, len(data)
            offset += len(data)
        self.frames.append((len(packed), offset))
        self.position += len(packed)
        self.unpacked += offset
        self.open, self.open_size = [], 0

    def close(self) -> Iterator[tuple]:
        yield from self.end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(bundle: str) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of every frame, from the end of the file."""
    files, path = pyarrow.fs.FileSystem.from_uri(bundle)
    with files.open_input_file(path) as f:
        size = f.size()
        n, descriptor, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or descriptor & 0x7C:
            raise ValueError(f"{bundle} has no seek table")
        width = 12 if descriptor & 0x80 else 8
        entries = f.read_at(n * width, size - 9 - n * width)
    out, at = [], 0
    for i in range(n):
        packed, unpacked = struct.unpack_from("<II", entries, i * width)
        out.append((at, packed, unpacked))
        at += packed
    return out


def _table(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kind]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(columns, kind, strict=True)], schema=kind
    )


_INDEX_KIND = pa.schema([
    ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()),
    ("frame_size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
])
_RECORD_KIND = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()),
])


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page into bundles in ``folder`` (an address that pyarrow can write to).

    Returns the index, itself written. Of pages with equal payloads of at least 100 bytes the
    smallest page_id is the response and the others revisit it; rows that repeat that very
    page_id are responses too, as no record can refer to itself, and so are pages without an id,
    to which nothing can refer. A null payload is empty.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    equal = (
        rows.filter(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first")
    )
    known = salted_lookup(rows, equal, "digest", ["page_id"])
    first = F.when((F.col("page_id") != F.col("first")) & F.col("page_id").isNotNull(), F.col("first"))
    known = known.select("page_id", "url", "payload", "digest", first.alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                page, url, payload, digest, first = (c[i].as_py() for c in batch.columns)
                if bundle is None:
                    bundle = Bundle(folder)
                rows += bundle.add(record_id(page), record(page, url, payload, digest, first))
                if bundle.unpacked >= BUNDLE_BYTES:
                    rows += bundle.close()
                    bundle = None
            yield _table(rows, _INDEX_KIND)
        if bundle is not None:
            yield _table(list(bundle.close()), _INDEX_KIND)

    return written(known.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records of (a part of) an index, read by frame and offset; payloads are verified.

    Frames, which are alike in size, are dealt out to tasks, ``FRAMES_READ`` to each on average; the
    count keeps the planner from packing the small index into one task.
    """
    tasks = -(-index.select("bundle", "frame_start").distinct().count() // FRAMES_READ)
    dealt = index.repartition(max(1, tasks), "bundle", "frame_start")
    frames = dealt.groupBy("bundle", "frame_start", "frame_size").agg(
        F.collect_list(F.struct("offset", "length")).alias("places")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                bundle, start, size, places = (c[i].as_py() for c in batch.columns)
                files, path = pyarrow.fs.FileSystem.from_uri(bundle)
                with files.open_input_file(path) as f:
                    whole = unpacker.decompress(f.read_at(size, start))
                found = [parsed(whole[p["offset"] : p["offset"] + p["length"]]) for p in places]
                yield _table([tuple(x.values()) for x in found], _RECORD_KIND)

    return frames.mapInArrow(read, RECORD)


SQL = f"""
with p as (
  select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as d from pages),
f as (
  select d, min(page_id) as first from p where strlen(h) >= {LEAST_REVISIT} group by d having count(*) > 1)
select page_id, strlen(h)::bigint as payload_bytes, p.d as payload_digest,
  case when page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to
from p left join f on p.d = f.d
"""


@query("op1_warc", SQL)
def op1_warc(spark, sf_dir):
    index = archive(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_records(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
