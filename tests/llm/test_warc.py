import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from lapidary.llm import common, warc


def pages():
    rows = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (3, "http://a/2", "same")]
    rows += [(None, "http://n", "same"), (1, "http://e", ""), (2, "http://e2", None), (None, "u", "alone"), (7, "http://x", "né\r\n\r\nWARC/1.1" + "y" * 300_000)]
    return [(*r, "clash") for r in rows + [(100 + i, f"http://p/{i}", f"page {i} " * 50) for i in range(300)]]


def brute(rows):
    """Every row of the round trip, by looking at all pages for each."""
    payload = lambda r: (r[2] or "").encode()
    for r in rows:
        same = [x[0] for x in rows if payload(x) == payload(r) and x[0] is not None]
        first = min(same, default=None)
        revisit = first is not None and first != r[0]
        yield r[0], len(payload(r)), base64.b32encode(hashlib.sha1(payload(r)).digest()).decode(), "revisit" if revisit else "response", first if revisit else None


@pytest.mark.parametrize("share", [10_000, 4])
def test_round_trip(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string, record_type string").repartition(3)
    got = warc.round_trip(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute(pages())))
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_the_index_is_a_map_and_dates_are_there(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "b"), (1, "v", "a"), (None, "u", "a"), (None, "v", "a"), (2, "u", "a")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/b", "2025-01-02T03:04:05Z")
    bundles = spark.read.parquet(f"file://{tmp_path}/b")
    ids = [r.record_id for r in warc.index(bundles).collect()]
    assert len(set(ids)) == len(rows)
    records = warc.read(bundles).collect()
    assert {r.refers_to for r in records} - {None} <= set(ids)
    for r in bundles.collect():
        reader = warc.BundleReader(bytes(r.archive))
        for own, frame, offset in zip(r.record_ids, r.frames, r.offsets, strict=True):
            head, _ = reader.record_at(frame, offset)
            assert (head["WARC-Record-ID"], head["WARC-Date"]) == (own, "2025-01-02T03:04:05Z")


def test_seek(spark, tmp_path):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string, record_type string").coalesce(1)
    warc.write(frame, f"file://{tmp_path}/bundles")
    bundles = spark.read.parquet(f"file://{tmp_path}/bundles")
    places = warc.index(bundles).filter(F.col("record_id").startswith("<urn:page:250:")).collect()
    archive = {r.bundle: bytes(r.archive) for r in bundles.collect()}
    head, body = warc.BundleReader(archive[places[0].bundle]).record_at(places[0].frame, places[0].offset)
    assert head["WARC-Record-ID"] == places[0].record_id and body == b"page 150 " * 50
    assert any(r.frame > 0 for r in warc.index(bundles).collect())
    (tmp_path / "files").mkdir()
    warc.export(bundles, str(tmp_path / "files"))
    for file in (tmp_path / "files").iterdir():
        plain = zstandard.ZstdDecompressor().stream_reader(file.read_bytes(), read_across_frames=True).read()
        assert len(list(warc.parsed(plain))) == len(next(r.record_ids for r in bundles.collect() if r.bundle == file.name))
