"""WARC records in seekable Zstandard bundles.

A worker packs records into frames of about ``FRAME_BYTES``, each compressed on its
own, and frames into bundles.  A bundle ends with the seek table of the seekable
format: a skippable frame with the compressed and uncompressed length of each frame
and a footer.  The index, a table, maps a record's id to its bundle, its frame and its
offset within the uncompressed frame, so one record costs one frame.

Bundles have fresh names and appear only when whole; the index holds those of tasks
that Spark committed, so a task that runs again, or an executor that goes, leaves at
most a file that nothing points to.  Folder and workers share any file system that
``pyarrow.fs`` opens by URI.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes that with the smallest
page_id is a response, others are revisits of it.  Defined results: a null html is an
empty payload; rows that repeat the smallest page_id with the same payload are all
responses; a null page_id is larger than any number, and refers to the smallest where
there is one; a null url leaves out the target; other columns play no part.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.shared import stored
from cellwatch.session import scratch_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
REVISIT_BYTES = 100
#: Magic numbers of the seekable format, fixed values.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, start int, length int"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "url string, payload string")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.rpartition(":")[2].rstrip(">")
    return None if name == "null" else int(name)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        # Percent signs too, so that decoding gives the very url.
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c in "%\r\n" else c for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple:
    """The values of ``RECORD``; the digest of a response is worked out from its payload and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b": ")[2])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        from urllib.parse import unquote

        url = unquote(url) if "%" in url else url
    page = page_of(fields["WARC-Record-ID"])
    if kind == "revisit":
        return page, size, digest, kind, page_of(fields["WARC-Refers-To"]), url, None
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record of page {page} is damaged")
    return page, size, digest, kind, None, url, payload.decode()


class BundleWriter:
    """One bundle: frames in memory until it is closed, then one file under a fresh name."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.out, self.frame = io.BytesIO(), bytearray()

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and length of a record."""
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self.end_frame()
        start = len(self.frame)
        self.frame += record
        return len(self.frames), start, len(record)

    def end_frame(self) -> None:
        packed = self.compressor.compress(bytes(self.frame))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.frame)))
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        with self.store.open_output_stream(f"{self.folder}/.{self.name}", compression=None) as file:
            file.write(self.out.getbuffer())
        self.store.move(f"{self.folder}/.{self.name}", f"{self.folder}/{self.name}")


class BundleReader:
    """Frames of one bundle by number."""

    def __init__(self, folder: str, name: str):
        store, path = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags & 0x7C:
            raise ValueError(f"{name} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * width, size - 9 - count * width)
        self.places, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.places[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def _uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"


def classified(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to, revisit`` per page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = (
        rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    )
    rows = rows.join(first.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write a record per page; the folder of the bundles, and the stored index (``INDEX``)."""
    spark = pages.sparkSession
    folder = _uri(folder or scratch_path(spark, "warc"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []

        def done() -> pa.RecordBatch:
            bundle.close()
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["page_id", "bundle", "frame", "start", "length"])

        for batch in batches:
            for page, url, html, digest, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns]):
                if bundle is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path, recursive=True)
                    bundle, rows = BundleWriter(folder), []
                place = bundle.add(encode_record(page, url, html.encode(), digest, refers_to, revisit))
                rows.append((page, bundle.name, *place))
                if bundle.out.tell() > BUNDLE_BYTES:
                    yield done()
                    bundle = None
        if bundle is not None:
            yield done()

    return folder, stored(classified(pages).mapInArrow(work, INDEX), "warc-index")


def read_archives(folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (``RECORD``) that ``index`` names, each frame opened once; without ``payloads`` that column is null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader, number, frame = None, None, None, b""
        for batch in batches:
            rows = []
            for bundle, f, start, length in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "start", "length")]):
                if bundle != name:
                    name, reader, number = bundle, BundleReader(folder, bundle), None
                if f != number:
                    number, frame = f, reader.frame(f)
                row = decode_record(frame[start:start + length])
                rows.append(row if payloads else (*row[:-1], None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    # A task for each bundle: adaptive execution would go by the index's size, which is small.
    bundles = max(1, index.select("bundle").distinct().count())
    ordered = index.repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame", "start")
    return ordered.mapInArrow(work, RECORD)
