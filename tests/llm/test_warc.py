from __future__ import annotations

import base64
import hashlib
import struct

import zstandard
from pyspark.sql import functions as F

from sievemark.llm import warc

ROWS = [
    (5, "http://a/", "same page"),
    (3, "http://b/", "same page"),
    (9, None, "same page"),
    (3, "http://b/", "same page"),
    (None, "http://c/ x\r\ny", "same page"),
    (1, "http://d/", None),
    (2, "http://e/", ""),
    (7, "http://f/", "é\r\n\r\nWARC/1.1 P*M\x18\0\0\0\0" * 3),
    (8, "http://g/", "long " * 400_000),
    (None, None, "alone"),
]


def expected():
    out = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        first = min((p for p, _, h in ROWS if (h or "") == (html or "") and p is not None), default=None)
        response = first is None or page == first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("mine"))


def test_round_trip_of_awkward_pages(spark):
    got = warc.archived(pages(spark)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected()
    assert warc.archived(pages(spark, [])).count() == 0


def test_payloads_and_frames(spark, tmp_path):
    many = [(i, f"http://h/{i}", f"<html><body>page {i % 70} of many, with a common frame</body></html>" * 20) for i in range(300)]
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, many).coalesce(1), path)
    rows = warc.read_archives(spark, path).collect()
    assert all(r.intact for r in rows if r.record_type == "response") and sum(r.record_type == "response" for r in rows) == 70
    assert {r.page_id: r.payload.decode() for r in rows if r.payload is not None} == {i: t for i, _, t in many if i < 70}
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    plain = b"".join(warc.record(r.page_id, r.url, b"", None) for r in rows)
    assert sum(map(len, files)) < len(plain)
    for data in files:
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        # any Zstandard reader with the dictionary reads on through all frames
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data[8 + size :], read_across_frames=True)
        assert reader.read().count(b"WARC/1.1\r\n") == len(list(warc.records(data)))


def test_small_payloads_can_be_kept(spark):
    rows = warc.with_roles(pages(spark), revisit_from=10).collect()
    assert all(r.refers_to is None for r in rows)


def test_frames_of_several_blocks_and_kinds():
    packer = zstandard.ZstdCompressor(write_checksum=True)
    parts = [packer.compress(p) for p in (b"", b"a" * 1_000_000, bytes(range(256)) * 2000)]
    data = b"".join(parts)
    at = 0
    for p in parts:
        assert warc.frame_end(memoryview(data), at) == at + len(p)
        at += len(p)
