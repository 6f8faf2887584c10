from __future__ import annotations

import hashlib
import io

import pyarrow.fs
import pytest
import zstandard
from oracle import same
from pyspark.sql import functions as F

from rollcall.llm import warc
from rollcall.llm.common import scratch

LONG = "<p>" + "équal " * 60
PAGES = [
    (7, "http://a/1", LONG), (3, "http://a/2 x\r\nEvil: 1", LONG), (9, None, LONG), (3, "http://a/2", LONG),
    (None, "u", LONG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (8, "u", "short"),
    (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100),
    (20, "u", "big " * 400_000), (21, "u", "WARC/1.1\r\n\r\nHTTP/1.1\r\n\r\n" * 9),
]


@pytest.fixture
def pages(spark):
    schema = "page_id bigint, url string, html string"
    return spark.createDataFrame(PAGES, schema).selectExpr("*", "'d' as digest", "1 as first", "2 as n").repartition(2)


def test_round_trip(spark, pages):
    index = warc.archive(pages, scratch(spark, "test"))
    got = warc.read_records(index).collect()
    assert len(got) == len(PAGES)
    texts = {i: h or "" for i, _, h in PAGES}
    for r in got:
        data = texts[r.page_id].encode()
        assert r.payload_digest == hashlib.sha256(data).hexdigest() and r.payload_bytes == len(data)
        assert r.payload == (data if r.record_type == "response" else None)
    refers = {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"}
    assert refers == {(7, 3), (9, 3), (13, 12)}
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    same(warc.read_records(index).select(columns), warc.SQL, {"pages": pages.toArrow()})
    # One record alone is found by its identifier.
    one = warc.read_records(index.filter(F.col("record_id") == warc.record_id(21))).collect()
    assert [r.page_id for r in one] == [21] and one[0].payload == texts[21].encode()


def test_bundles_are_seekable_and_plain(spark, pages, monkeypatch):
    index = warc.archive(pages, scratch(spark, "test")).collect()
    for bundle in {r.bundle for r in index}:
        files, path = pyarrow.fs.FileSystem.from_uri(bundle)
        with files.open_input_file(path) as f:
            whole = f.read()
        frames = warc.seek_table(bundle)
        own = [r for r in index if r.bundle == bundle]
        assert {(r.frame, r.frame_start, r.frame_size) for r in own} == {
            (i, at, packed) for i, (at, packed, _) in enumerate(frames)
        }
        # Any reader unpacks the bundle from front to end, and any frame alone.
        text = b""
        for at, packed, unpacked in frames:
            part = zstandard.ZstdDecompressor().decompress(whole[at : at + packed])
            assert len(part) == unpacked
            text += part
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True)
        assert reader.read() == text
        assert text.count(b"WARC-Record-ID") == len(own)
        assert max(u for *_, u in frames) <= max(warc.FRAME_BYTES + max(r.length for r in own), 0)


def test_changed_payload_is_noticed():
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parsed(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="not what was written"):
        warc.parsed(data.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaf"))


def test_empty(spark, pages):
    index = warc.archive(pages.limit(0), scratch(spark, "test"))
    assert index.count() == 0 and warc.read_records(index).count() == 0


def test_query_against_sql(spark, small):
    same(warc.op1_warc(spark, small), warc.SQL, {"pages": f"{small}/pages.parquet"})


def test_frames_are_read_by_several_tasks(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "FRAMES_READ", 1)
    monkeypatch.setattr(warc, "FRAME_BYTES", 200)
    index = warc.archive(pages, scratch(spark, "test"))
    frames = index.select("bundle", "frame_start").distinct().count()
    found = warc.read_records(index)
    tasks = found.select(F.spark_partition_id().alias("task")).distinct().count()
    assert frames > 3 and tasks > 1 and found.count() == pages.count()
