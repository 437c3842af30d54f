"""Bundles of WARC records: round trips, seek tables, and records found by their offsets."""

import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from gridweave.llm import warc_bundles as warc

SCHEMA = "page_id bigint, url string, html string, key string, ordinal int, bundle string, digest string, payload string"
LONG = "<p>é</p>" * 400_000
ROWS = [(1, "http://a/", "one"), (2, "http://a/\r\nWARC-Type: x", "one"), (2, "http://b/", "one"), (3, None, None), (4, "u", ""), (None, "n", "two"), (None, "n", "two"), (5, "v", LONG), (7, "w", LONG), (6, "x", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1"), (-1, "y", "퟿\x00\r\n")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "k", 1, "b", "d", "p") for r in ROWS], SCHEMA)


def expected():
    out = []
    for key, _, html in ROWS:
        same = [(k is not None, k or 0) for k, _, h in ROWS if (h or "") == (html or "")]
        data = (html or "").encode()
        out.append((key, len(data), warc.bare_digest(data), max(same)[1] if max(same)[0] else None))
    return out


@pytest.mark.parametrize("frame,bundle", [(1, 1), (200, 1 << 20), (1 << 20, 1 << 30)])
def test_what_is_read_back(pages, tmp_path, frame, bundle):
    index = warc.write_bundles(pages, f"file://{tmp_path}", frame_bytes=frame, bundle_bytes=bundle)
    found = warc.read_bundles(index).collect()
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"]) for r in found), key=str) == sorted(((k, n, d) for k, n, d, _ in expected()), key=str)
    largest = {d: k for _, _, d, k in expected()}
    for digest in largest:
        group = [r for r in found if r["payload_digest"] == digest]
        [response] = [r for r in group if r["record_type"] == "response"]
        assert response["key"] == largest[digest] and response["refers_to"] is None
        assert all(r["refers_to"] == largest[digest] and r["payload"] is None for r in group if r is not response)
        assert warc.bare_digest(response["payload"]) == digest
    fetched = warc.fetch_records(index.where(F.col("key").isin(5, 7, 6, 2))).collect()
    assert sorted((r["key"], r["ordinal"], r["record_type"]) for r in fetched) == sorted((r["key"], r["ordinal"], r["record_type"]) for r in found if r["key"] in (5, 7, 6, 2))


def test_seek_table_and_plain_decoders(pages, tmp_path):
    index = warc.write_bundles(pages.coalesce(1), str(tmp_path), frame_bytes=300)
    [path] = tmp_path.iterdir()
    data = path.read_bytes()
    frames, _, mark = struct.unpack("<IBI", data[-9:])
    assert mark == warc.FOOTER and frames == index.agg(F.max("frame")).first()[0] + 1
    with path.open("rb") as source:
        table = warc.seek_table(source, len(data))
    decoder = zstandard.ZstdDecompressor()
    parts = [decoder.decompress(data[at : at + packed], max_output_size=plain) for at, packed, plain in table]
    with decoder.stream_reader(data, read_across_frames=True) as whole:
        assert whole.read() == b"".join(parts)
    for r in index.collect():
        record = parts[r["frame"]][r["record_at"] : r["record_at"] + r["record_bytes"]]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and data[r["frame_at"] :][: r["frame_bytes"]] == data[table[r["frame"]][0] :][: table[r["frame"]][1]]


def test_broken_bundles_fail(pages, tmp_path, spark):
    index = warc.write_bundles(pages.where("page_id = 1").coalesce(1), str(tmp_path))
    [path] = tmp_path.iterdir()
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(Exception, match="no seek table"):
        warc.read_bundles(index).collect()


def test_small_payloads_are_all_responses(pages):
    found = warc.read_bundles(warc.write_bundles(pages, least=4)).groupBy("record_type").count().collect()
    assert dict(found) == {"response": len(ROWS) - 1, "revisit": 1}


def test_empty_and_short_tables(spark, pages):
    assert warc.archive_digest(pages.limit(0)).count() == 0
    out = warc.archive_digest(pages)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and out.count() == len(ROWS)
