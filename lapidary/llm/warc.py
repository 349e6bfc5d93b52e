"""WARC archives as seekable Zstandard bundles.

Each page becomes a WARC record: a ``response`` with the whole payload, or a ``revisit`` that
refers to the response with the same payload.  A task packs its records into bundles.  In a
bundle, groups of records are compressed into independent frames; the last frame is a
skippable one with the seek table (format of the Zstandard seekable format: magic numbers,
compressed and decompressed size of each frame, footer with the number of frames), so that
any Zstandard reader unpacks the bundle and any seekable reader opens a single frame.  A
second table maps record ids to (bundle, frame, offset in the unpacked frame).

Bundles are rows of a Parquet table in the shared folder, so they can be in any store that
Spark reaches.  :func:`export` also writes them as files where a path is mounted everywhere.

Nulls and ties: a null payload is empty.  Of equal payloads the smallest page id is the
response; every row that repeats that id and payload is a response too.  Pages without an
id refer to the one with an id; without any id in the group all are responses.  A record's
id names page, payload and address, so it is one record's own unless rows are equal in all
three; such records say the same, and any of them serves.  Payloads that a large share of
the pages has are not brought together in one task.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import dealt_join, hot_keys, shared_path, text_or_empty, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLES = "bundle string, archive binary, record_ids array<string>, frames array<int>, offsets array<bigint>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, digest: str, url: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{zlib.crc32((url or '').encode()):08x}>"


#: What a record id says.
PAGE_OF = r"^<urn:page:(.*):[A-Z2-7]{32}:[0-9a-f]{8}>$"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> tuple[str, bytes]:
    """(record id, WARC record) of one page; a revisit names the response's record and carries no payload of its own."""
    own = record_id(page_id, digest, url)
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return own, "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of each WARC record from an offset on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(headers["Content-Length"])
        yield at, headers, data[end + 4 : stop]
        at = stop + 4


class BundleWriter:
    """Packs records into frames, then adds the seek table."""

    def __init__(self) -> None:
        self.pack = zstandard.ZstdCompressor(level=3)
        self.out, self.frame, self.sizes = io.BytesIO(), bytearray(), []
        self.ids: list[str] = []
        self.frames: list[int] = []
        self.offsets: list[int] = []

    def add(self, record_id: str, data: bytes) -> None:
        self.ids.append(record_id)
        self.frames.append(len(self.sizes))
        self.offsets.append(len(self.frame))
        self.frame += data
        if len(self.frame) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.frame:
            packed = self.pack.compress(bytes(self.frame))
            self.sizes.append((len(packed), len(self.frame)))
            self.out.write(packed)
            self.frame = bytearray()

    def close(self) -> dict:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        data = self.out.getvalue()
        name = f"{hashlib.sha256(data).hexdigest()[:32]}.warc.zst"
        return {"bundle": name, "archive": data, "record_ids": self.ids, "frames": self.frames, "offsets": self.offsets}


class BundleReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.unpack = data, zstandard.ZstdDecompressor()
        count, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the bundle has no seek table")
        sizes = struct.iter_unpack("<II", data[-9 - 8 * count : -9])
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return self.unpack.decompress(self.data[at : at + packed], max_output_size=plain)

    def record_at(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        """One record, by unpacking its frame alone."""
        _, headers, body = next(parsed(self.frame(frame), offset))
        return headers, body


def packer(date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bundles of the records of (page_id, url, payload, sha1, first, first_url) rows."""
    schema = pa.schema([("bundle", pa.string()), ("archive", pa.binary()), ("record_ids", pa.list_(pa.string())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()
        for batch in batches:
            for page_id, url, payload, sha1, first, first_url in (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                refers_to = None if first is None or first == page_id else record_id(first, digest, first_url)
                writer.add(*record(page_id, url, payload.encode(), digest, refers_to, date))
                if writer.out.tell() >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pylist([writer.close()], schema)
                    writer = BundleWriter()
        if writer.ids:
            yield pa.RecordBatch.from_pylist([writer.close()], schema)

    return packed


def write(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Writes a record for each row of pages (page_id, url, html) as a table of bundles; date is that of all records, now if not given."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty("html").alias("payload"))
    # SHA-1 is what WARC states; payloads with one SHA-1 can be made, so they are matched by SHA-256
    rows = rows.withColumns({"sha1": F.sha1(F.col("payload").cast("binary")), "same": F.sha2(F.col("payload").cast("binary"), 256)})
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    firsts = rows.groupBy("same").agg(first, F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    firsts = written(firsts.select("same", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), "copies"), "first-pages")
    linked = dealt_join(rows, firsts.drop("copies"), "same", hot_keys(firsts, "same", "copies"), "left")
    now = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    linked.select("page_id", "url", "payload", "sha1", "first", "first_url").mapInArrow(packer(now), BUNDLES).write.parquet(path)


RECORDS = "bundle string, record_id string, frame int, offset bigint, record_type string, refers_to string, target string, payload_bytes bigint, payload_digest string, payload binary"


def read(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of a table of bundles, found through the index: its frame is unpacked and read from its offset on.

    Revisits have no payload.  The digest is worked out anew from the payload where there is one.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for name, archive, ids, frames, offsets in zip(*batch.columns, strict=True):
                reader = BundleReader(archive.as_py())
                rows, at, frame = [], -1, b""
                for own, k, offset in zip(ids.as_py(), frames.as_py(), offsets.as_py(), strict=True):
                    if k != at:
                        at, frame = k, reader.frame(k)
                    _, head, body = next(parsed(frame, offset))
                    if head["WARC-Record-ID"] != own:
                        raise ValueError(f"{own}: the index leads to {head['WARC-Record-ID']}")
                    response = head["WARC-Type"] == "response"
                    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if response and base32_sha1(body) != stated:
                        raise ValueError(f"{own}: the payload differs from its digest")
                    rows.append((name.as_py(), own, k, offset, head["WARC-Type"], head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), stated, body if response and with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return bundles.select("bundle", "archive", "record_ids", "frames", "offsets").mapInArrow(unpacked, RECORDS)


def index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset): where each record begins."""
    return bundles.select("bundle", F.explode(F.arrays_zip("record_ids", "frames", "offsets")).alias("x")).select(
        F.col("x.record_ids").alias("record_id"), "bundle", F.col("x.frames").alias("frame"), F.col("x.offsets").alias("offset")
    )


def export(bundles: DataFrame, folder: str) -> None:
    """Writes each bundle as a file in a folder that every executor has mounted; a repeated task writes the same file again."""
    import os

    def put(rows) -> None:
        for row in rows:
            draft = f"{folder}/.{row.bundle}.{uuid.uuid4().hex}"
            with open(draft, "wb") as out:
                out.write(row.archive)
            os.replace(draft, f"{folder}/{row.bundle}")

    bundles.select("bundle", "archive").foreachPartition(put)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, offset) as read back from the archives."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.regexp_extract(c, PAGE_OF, 1), F.lit("")).cast(kind)
    return read(spark.read.parquet(path), with_payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "bundle", "frame", "offset"
    )
