import base64
import hashlib

import pytest
import zstandard

from folkscope.llm import warc as W
from folkscope.session import scratch_path

SCHEMA = "page_id long, url string, html string, payload string, refers_to string"
ROWS = [
    (1, "http://a/\r\nX: y", "same"), (2, None, "same"), (9, "http://c", "same"), (3, "u", ""), (4, "u", None), (5, "u", "é" * 9),
    (None, "u", "same"), (None, "u", "alone"), (7, "u", "twice"), (7, "u", "twice"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 3), (10, "u", "x" * 300_000),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def want(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        latest = max(ids, default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        refers = None if page_id == latest else latest
        out.append((page_id, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame_bytes", [1, 700, 1 << 20])
def test_written_records_are_read_back(spark, frame_bytes):
    index = W.write_bundles(pages(spark, ROWS), scratch_path(spark, "warc"), frame_bytes=frame_bytes)
    assert index.count() == len(ROWS)
    rows = W.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == want(ROWS)


def test_bundles_close_at_their_size_and_stay_plain_zstd(spark):
    index = W.write_bundles(pages(spark, [(i, "u", f"{i}" * 5000) for i in range(40)]).coalesce(1), scratch_path(spark, "warc"), frame_bytes=1000, bundle_bytes=2000)
    names = [r.bundle for r in index.select("bundle").distinct().collect()]
    assert len(names) > 1
    for name in names:  # any zstd reader sees all records, the seek table is skippable
        with W.open_input(name) as file:
            plain = zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True).read()
        offset, seen = 0, 0
        while offset < len(plain):
            _, _, offset = W.parse_record(plain, offset)
            seen += 1
        assert seen == index.where(index.bundle == name).count()


def test_frames_are_read_by_as_many_tasks_as_they_need(spark):
    rows = [(i, "u", f"{i} " * 3000) for i in range(64)]
    index = W.write_bundles(pages(spark, rows).coalesce(2), scratch_path(spark, "warc"), frame_bytes=20_000)
    frames = index.select("bundle", "frame").distinct().count()
    out = W.read_bundles(index, task_frames=4)
    assert out.rdd.getNumPartitions() == -(-frames // 4) > 1
    assert out.count() == 64


def test_repeated_ids_with_equal_payloads_in_different_bundles(spark):
    rows = [(7, "u", "twice"), (1, "u", "twice")] * 20
    index = W.write_bundles(pages(spark, rows).repartition(8), scratch_path(spark, "warc"), frame_bytes=50, bundle_bytes=100)
    assert index.select("bundle").distinct().count() > 1
    out = W.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, out), key=str) == want(rows)


def test_a_damaged_frame_is_noticed(tmp_path):
    writer = W.BundleWriter(f"{tmp_path}/b.warc.zst")
    writer.add(W.record(1, "u", b"x" * 1000, None))
    writer.close()
    data = bytearray((tmp_path / "b.warc.zst").read_bytes())
    data[-13] ^= 1  # in the checksum of the only frame
    (tmp_path / "b.warc.zst").write_bytes(data)
    with pytest.raises(ValueError):
        W.BundleReader(f"{tmp_path}/b.warc.zst").frame(0)


def test_empty_table(spark):
    assert W.read_bundles(W.write_bundles(pages(spark, []), scratch_path(spark, "warc"))).count() == 0
