"""Operator 2: WARC archives with dictionary compression (``.warc.zst``), written and read by Spark.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from
its own records; every record is a Zstandard frame of its own that uses it. Spark's text writer puts the
files in place (so commits, retries and any file system work as for other tables): a row is a frame, and
the line separator is an empty skippable frame, eight bytes that every Zstandard reader passes over.

Payloads are told apart by SHA-1. Of equal payloads of at least ``revisit_from`` bytes the row with the
smallest page id is a ``response``, the others are ``revisit`` records without a payload, which name it.
Digests that occur once never meet in a join partner; digests that occur often are counted with partial
sums and joined from a stored table, so AQE can split them.

Cases: a null html is an empty payload; a null url becomes ``urn:page:<id>``; a null page id is larger
than all others and is written without an id; repeated rows of the smallest id are all responses. An
empty table gives no archive and an empty result. A page of any length is one record. Columns of the
input besides id, url and html are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.session import scratch_path, stored

# Frames of the format.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", SKIPPABLE[0], 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
TRAIN_BYTES = 3 << 20  # records of an archive that its dictionary is built from; their order is that of a digest
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return uuid.UUID(bytes=hashlib.sha1(f"{page_id}:{digest}".encode()).digest()[:16], version=5).urn


def _clean_uri(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers of one."""
    digest = base32(hashlib.sha1(payload).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_record_id(page_id, digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_record_id(refers_to, digest)}>", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the records; too few or too small ones serve as raw content."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) >= 16 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8)
        except zstandard.ZstdError:
            pass  # all records alike or all tiny: no segments to choose from
    raw = b"".join(samples)[-DICTIONARY_BYTES:]
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive of a task's rows: the dictionary frame, then a frame for each record."""
    compressor = None
    waiting: list[bytes] = []
    size = 0

    def packed(frames: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    def begin() -> list[bytes]:
        nonlocal compressor
        dictionary = trained(waiting)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        data = dictionary.as_bytes()
        frames = [struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data, *map(compressor.compress, waiting)]
        waiting.clear()
        return frames

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True)
        frames = []
        for row in rows:
            made = record(*row)
            if compressor is None:
                waiting.append(made)
                size += len(made)
                if size >= TRAIN_BYTES:
                    frames += begin()
            else:
                frames.append(compressor.compress(made))
        if frames:
            yield packed(frames)
    if waiting:
        yield packed(begin())


def with_roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to)``; ``refers_to`` is null for a response."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload"))})
    often = rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    often = stored(often.where("n > 1").select(F.col("digest").alias("_digest"), "first"), "payloads")
    joined = rows.join(often, rows.digest == often._digest, "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """One ``.warc.zst`` stream for each task of the join by digest; AQE sets their size."""
    frames = with_roles(pages, **columns).mapInArrow(_frames, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("latin-1")).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends (RFC 8878: header, blocks, checksum)."""
    descriptor = data[at + 4]
    single = descriptor >> 5 & 1
    content = (single, 2, 4, 8)[descriptor >> 6]
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[descriptor & 3] + content
    last = False
    while not last:
        block = int.from_bytes(data[end : end + 3], "little")
        last = bool(block & 1)
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    return end + 4 * (descriptor >> 2 & 1)


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive: its dictionary frame is used, other skippable frames are passed over."""
    data, at = memoryview(archive), 0
    decompressor = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC:
                dictionary = bytes(data[at + 8 : at + 8 + size])
                if dictionary[:4] == ZSTD_MAGIC.to_bytes(4, "little"):
                    dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            at += 8 + size
        elif magic == ZSTD_MAGIC:
            end = frame_end(data, at)
            yield decompressor.decompressobj().decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long,"
    " payload binary, intact boolean"
)


def parsed(made: bytes) -> tuple:
    """A record as a row of :data:`SCHEMA`; ``intact``: a response's payload has the digest of its header."""
    head, _, rest = made.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    number = {k: int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page-id")}
    if fields["warc-type"] == "revisit":
        size, payload, intact = int(_fields(http)["content-length"]), None, None
    else:
        size, intact = len(payload), base32(hashlib.sha1(payload).digest()) == digest
    return (number["page-id"], fields["warc-target-uri"], size, digest, fields["warc-type"], number["refers-to-page-id"], payload, intact)


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder; an archive is one file that one task reads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

        for files in batches:
            for archive in files.column("content"):
                rows = []
                for made in records(archive.as_py()):
                    row = parsed(made)
                    rows.append(row if payloads else (*row[:6], None, row[7]))
                    if len(rows) >= 1000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, SCHEMA)


def archived(pages: DataFrame, **columns) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return read_archives(pages.sparkSession, path, payloads=False)


def oracle() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    four = " || ".join(f"substr('{letters}', (v >> {s} & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (1 + 5 * i)::INT, 5))::INT), lambda v: {four}), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
