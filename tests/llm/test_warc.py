"""Archives: exact round trips, however byte ranges cut them."""

import gzip
import hashlib
import io
import random

import pyarrow as pa

from tidepanel.llm import warc
from tidepanel.session import scratch_path


def test_every_cut_owns_every_record_once():
    draw = random.Random(1)
    bodies = [bytes(draw.randrange(256) for _ in range(draw.randrange(0, 400))) for _ in range(30)]
    bodies[3] = b"x" + warc.MAGIC + b"\x00" * 40
    contents = [warc.record(i, f"http://a/{i} b", body, None) for i, body in enumerate(bodies)]
    data = b"".join(warc.member(c) + warc.member(b"") for c in contents)
    assert gzip.decompress(data) == b"".join(contents)
    for size in (1, 7, 64, 333, 5000, len(data)):
        found = [c for at in range(0, len(data), size) for c in warc.records(pa.BufferReader(data), at, at + size)]
        assert found == contents, size
    assert warc.parsed(contents[3])[1].partition(b"\r\n\r\n")[2] == bodies[3]
    assert io.BytesIO(data).read(3) == warc.MAGIC


def test_pages_round_trip(spark):
    long = "é" * 600
    rows = [(1, "u", long, 0), (9, "u\n", long, 0), (9, "u", long, 0), (None, None, long, 0), (3, "u", "short", 0), (4, "u", "short", 0),
            (5, "u", None, 0), (6, "u", "", 0), (7, "u", "z" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = scratch_path(spark, "warc-test")
    warc.write(pages, path)
    got = warc.read(spark, path, range_bytes=50).collect()
    assert len(got) == len(rows)
    expect = {(p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == long and p != 9 else "response",
               9 if h == long and p != 9 else None) for p, _, h, _ in rows}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expect
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for p, _, h, _ in rows}


def test_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).collect() == []
