"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; after the last frame a skippable frame holds the
seek table (sizes of every frame before and after compression) in the published seekable
format, so a reader finds any frame from the end of the file. An index row for each record
gives bundle, frame and offset inside the frame.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import scratch, stored, table
from gridloom.llm.token_output import put_file

#: Fixed values of the seekable format: skippable frame, and the table's closing magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame, and of frames in a bundle, before the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: Payloads of fewer bytes are never replaced by a revisit.
REVISIT_BYTES = 100


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of (compressed, plain) bytes."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


class Bundle:
    """Random access to the frames of a bundle through ``read(offset, length)``."""

    def __init__(self, read, size: int):
        self.read = read
        n, _, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        raw = read(size - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for k in range(n):
            c, d = struct.unpack_from("<II", raw, 8 * k)
            self.frames.append((at, c, d))
            at += c

    def frame(self, k: int) -> bytes:
        at, c, d = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.read(at, c), max_output_size=max(d, 1))


def opened(uri: str) -> Bundle:
    """A bundle in any store that pyarrow knows."""
    store, path = pafs.FileSystem.from_uri(uri)
    f = store.open_input_file(path)

    def read(offset, length):
        f.seek(offset)
        return f.read(length)

    return Bundle(read, f.size())


def _line(value) -> str:
    """A header value: without line ends or other control characters, percent-coded where needed."""
    return re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response record, or a revisit with the payload's digest and length but not the payload."""
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, payload and end of the record at a place of a frame."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = stop + 4
    end = start + int(headers["Content-Length"])
    return headers, data[data.index(b"\r\n\r\n", start) + 4 : end], end + 4


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and refers_to.

    Of rows whose payloads of at least REVISIT_BYTES bytes are equal, the smallest page_id is the
    response (of repeated rows of that page_id each is), the others refer to it. Null html is an
    empty payload; null page_ids refer to the smallest id, or are responses where there is none.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    large = p.where(F.length("payload") >= REVISIT_BYTES)
    # only digests that occur again are joined back, so the usual page meets no partner
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first")
    joined = p.join(first, "digest", "left")
    other = (F.length("payload") >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages`` and return the stored index: page_id, uri, frame, place, length.

    Each task writes its rows in the order of page_id, url and digest (nulls first; rows equal in all are
    equal records), so one that is run again replaces its bundles by the same bytes under the same names. An
    empty table writes no bundle. A frame holds at least one record whole, however long its payload; other
    columns are not archived.
    """
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def write(batches):
        part, k = TaskContext.get().partitionId(), 0
        frames, sizes, now, index = [], [], bytearray(), []
        press = zstandard.ZstdCompressor(level=3)

        def close_frame():
            frames.append(press.compress(bytes(now)))
            sizes.append((len(frames[-1]), len(now)))
            now.clear()

        def close_bundle():
            uri = f"{folder}/part-{part:06d}-{k:05d}.warc.zst"
            put_file(uri, [*frames, seek_table(sizes)])
            out = pa.record_batch([pa.array([x[0] for x in index], pa.int64()), pa.array([uri] * len(index)), *(pa.array([x[i] for x in index], pa.int64()) for i in (1, 2, 3))], ["page_id", "uri", "frame", "place", "length"])
            frames.clear(), sizes.clear(), index.clear()
            return out

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                r = record(page_id, url, payload, digest, refers_to)
                index.append((page_id, len(frames), len(now), len(r)))
                now += r
                if len(now) >= FRAME_BYTES:
                    close_frame()
                    if sum(c for c, _ in sizes) >= BUNDLE_BYTES:
                        yield close_bundle()
                        k += 1
        if now:
            close_frame()
        if frames:
            yield close_bundle()

    rows = with_revisits(pages).sortWithinPartitions("page_id", "url", "digest")
    return stored(rows.mapInArrow(write, "page_id long, uri string, frame long, place long, length long"), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, read frame by frame: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row for each row of the index, repeated and null page_ids included; one frame is held at a time.
    """

    def read(batches):
        uri, bundle, k, frame = None, None, None, b""
        for b in batches:
            out = []
            for page_id, at, n, place, length in zip(*(c.to_pylist() for c in b.columns)):
                if at != uri:
                    uri, bundle, k = at, opened(at), None
                if n != k:
                    k, frame = n, bundle.frame(n)
                headers, payload, end = parsed(frame, place)
                if end != place + length or headers["WARC-Record-ID"] != f"<urn:page:{'null' if page_id is None else page_id}>":
                    raise ValueError(f"the index does not fit {at}")
                kind = headers["WARC-Type"]
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                ref = headers.get("WARC-Refers-To")
                out.append((page_id, size, digest, kind, int(ref.strip("<>").rpartition(":")[2]) if ref else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("page_id", "uri", "frame", "place", "length").repartition(tasks, "uri", "frame").sortWithinPartitions("uri", "frame", "place")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, written and read back."""
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), q AS (
  SELECT page_id, n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
