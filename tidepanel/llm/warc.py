"""WARC archives: written by Spark, read back by byte ranges.

`write` stores each page as a record in a gzip member of its own. Files come
from Spark's text writer, so they go to any file system Spark can write, and the
commit protocol keeps those of lost tasks out. Its line separator, set to an
empty gzip member, stands between records: a file stays a plain series of gzip
members whose contents are the records.

`read` cuts the files into byte ranges that know nothing of each other. A task
scans its range for the gzip magic, takes a candidate as a member only if it
decodes to a WARC header, and owns the records that start inside the range, even
where they end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
REVISIT_BYTES = 1000
RANGE_BYTES = 4 << 20
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_control = re.compile(r"[\x00-\x20\x7F]")


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another record without."""
    response = refers_to is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_control.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        *([] if response else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Archive every row of (page_id, url, html); a null html is an empty payload.

    Of rows with equal payloads of `least` bytes or more, those with the largest
    page_id are responses and the others revisit it; rows that repeat a page_id
    and its html are alike in this. A null page_id counts as the smallest.
    Payloads are compared by length and SHA-1.
    """
    full = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    full = full.withColumn("digest", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")))
    keepers = (full.where(F.octet_length("payload") >= least).groupBy("digest")
               .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper"))
    marked = full.join(keepers, "digest", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c] for c in ("page_id", "url", "payload", "refers_to")), strict=True)
            made = [member(record(*(v.as_py() for v in row))) for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    (marked.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path))


def opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def records(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """Contents of the members that start in [start, end) and hold a WARC record."""
    data, base = b"", start  # data[i] is the file's byte base + i

    def more(size: int = CHUNK) -> bool:
        nonlocal data
        file.seek(base + len(data))
        part = file.read(size)
        data += part
        return bool(part)

    at = start
    while at < end:
        if at - base > CHUNK:
            data, base = data[at - base:], at
        found = data.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(data) - len(MAGIC) + 1)
            if not more():
                return
            continue
        at = base + found
        if at >= end:
            return
        unpacker, out, fed = zlib.decompressobj(31), [], found
        try:
            while not unpacker.eof:
                if fed == len(data) and not more():
                    raise zlib.error("the file ends inside a member")
                out.append(unpacker.decompress(data[fed:fed + CHUNK]))
                fed = min(len(data), fed + CHUNK)
                if sum(map(len, out[:2])) >= 7 and not b"".join(out[:2]).startswith(b"WARC/1."):
                    raise zlib.error("no WARC header")
        except zlib.error:
            at += 1
            continue
        content = b"".join(out)
        if content.startswith(b"WARC/1."):
            yield content
        at = base + fed - len(unpacker.unused_data)


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {name.lower(): value for name, value in fields.items()}
    return headers, rest[: int(headers["content-length"])]


def page_of(reference: str | None) -> int | None:
    number = (reference or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives under `path`, each once, however the ranges cut them.

    A response's digest is that of the payload as read, which must be the one in
    its header. A revisit's length is the one that its HTTP header states, and
    its `payload` is null.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    step = F.lit(range_bytes).cast("long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                rows: list[dict] = []
                with opened(place) as file:
                    for content in records(file, start, start + range_bytes):
                        rows.append(row(*parsed(content)))
                        if len(rows) == 256:
                            yield as_batch(rows)
                            rows = []
                yield as_batch(rows)

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
                 "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    def row(headers: dict[str, str], block: bytes) -> dict:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        whole = headers["warc-type"] == "response"
        if whole and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
            raise ValueError(f"damaged record {headers['warc-record-id']}")
        return {"page_id": page_of(headers["warc-record-id"]), "url": headers["warc-target-uri"], "payload_bytes": size,
                "payload_digest": digest.hex(), "record_type": headers["warc-type"], "refers_to": page_of(headers.get("warc-refers-to")),
                "payload": payload if whole and payloads else None}

    # A count of its own, which adaptive execution leaves alone: rows that name ranges are small, what they stand for is not.
    count = files.agg(F.sum(F.ceil(F.col("length") / F.lit(range_bytes)))).first()[0] or 1
    return ranges.repartition(int(count)).mapInArrow(run, SCHEMA)
