"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some whole WARC records; then a
skippable frame with the record index (record id to frame and offset in it), and a skippable
frame with the seek table (compressed and plain size of each frame) that ends in the magic
number of the seekable format. A reader that has the last bytes finds any record and unpacks
one frame. Bundles are rows of a table in the shared folder, written once and read back;
``export`` makes them files that any Zstandard tool unpacks, ``imported`` reads such files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Written, text_of

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
LEVEL = 3
DATE = "2025-01-01T00:00:00Z"
_SKIPPABLE_INDEX, _SKIPPABLE_SEEK, _SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    return "".join(c if 32 <= ord(c) != 127 else f"%{ord(c):02X}" for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; ``refers_to`` makes it a revisit, whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames; ``finish`` gives the archive's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.packer, self.limit = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.open, self.fill, self.total = [], 0, 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append((page_id, len(self.sizes), self.fill, len(data)))
        self.open.append(data)
        self.fill += len(data)
        if self.fill >= self.limit:
            self._close()

    def _close(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            frame = self.packer.compress(plain)
            self.frames.append(frame)
            self.sizes.append((len(frame), len(plain)))
            self.total += len(frame)
            self.open, self.fill = [], 0

    def finish(self) -> bytes:
        self._close()
        index = self.packer.compress(json.dumps(self.index, separators=(",", ":")).encode())
        seek = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEK_MAGIC)
        tail = struct.pack("<II", _SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", _SKIPPABLE_SEEK, len(seek)) + seek
        return b"".join(self.frames) + tail


class Reader:
    """Random access to a bundle through its seek table."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != _SEEK_MAGIC or flags:
            raise ValueError("not a seekable bundle")
        at = len(data) - 9 - 8 * n
        self.data, self.unpacker = data, zstandard.ZstdDecompressor()
        sizes = [struct.unpack("<II", data[at + 8 * i : at + 8 * i + 8]) for i in range(n)]
        self.frames, start = [], 0
        for packed, plain in sizes:
            self.frames.append((start, packed, plain))
            start += packed
        magic, size = struct.unpack("<II", data[start : start + 8])
        if magic != _SKIPPABLE_INDEX:
            raise ValueError("the bundle has no index")
        self.index = json.loads(self.unpacker.decompress(data[start + 8 : start + 8 + size]))
        self.places: dict[int | None, tuple[int, int, int]] = {}
        for page_id, k, offset, length in self.index:
            self.places.setdefault(page_id, (k, offset, length))

    def frame(self, k: int) -> bytes:
        start, packed, plain = self.frames[k]
        return self.unpacker.decompress(self.data[start : start + packed], max_output_size=plain)

    def record(self, page_id: int | None) -> bytes:
        """The first record of ``page_id``; only its frame is unpacked."""
        k, offset, size = self.places[page_id]
        return self.frame(k)[offset : offset + size]

    def records(self) -> Iterator[bytes]:
        last, plain = -1, b""
        for _, k, offset, size in self.index:
            if k != last:
                last, plain = k, self.frame(k)
            yield plain[offset : offset + size]


def parse(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of a record; a response's digest is checked."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    refers = fields.get("WARC-Refers-To")
    return number(fields["WARC-Record-ID"]), size, digest, kind, number(refers) if refers else None, fields["WARC-Target-URI"], payload


def bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(bundle_id, n_records, archive): archives of all rows, about BUNDLE_BYTES each.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes that with the least id is
    the response and others revisit it; rows that repeat this id are responses too, and so are
    rows without an id. Null html is empty. Record ids are made of the rows' ids, so where rows
    repeat an id their records do too, and a look-up by id finds the first of a bundle.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    long_enough = F.octet_length("html") >= min_revisit_bytes
    # only payloads that occur under two ids are joined; their table is written, so its size is known
    shared = base.where(long_enough).groupBy(digest.alias("shared")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = Written(shared.where("first <> last").select("shared", "first")).df
    key = F.when(long_enough, digest)
    rows = base.withColumn("digest", key).join(shared, F.col("digest") == F.col("shared"), "left")
    rows = rows.select("id", "url", "html", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, k, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def out() -> pa.RecordBatch:
            nonlocal k, bundle
            n, data, name = len(bundle.index), bundle.finish(), f"{partition:06d}-{k:06d}"
            k, bundle = k + 1, Bundle()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["bundle_id", "n_records", "archive"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                bundle.add(page_id, record(page_id, url, html.encode("utf-8", "replace"), refers_to))
                if bundle.total >= BUNDLE_BYTES:
                    yield out()
        if bundle.index:
            yield out()

    return rows.mapInArrow(run, "bundle_id string, n_records long, archive binary")


def read(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row per record of a table of bundles: id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for data in batch.column(0):
                rows = [parse(r)[:5] for r in Reader(data.as_py()).records()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    out = archives.select("archive").mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.withColumnRenamed("id", id_col)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """(bundle_id, path, bytes): each bundle as ``<bundle_id>.warc.zst`` in ``folder``, a URI or path that all executors reach.

    The files are written when the result is computed. A task writes under a name of its own and
    then moves the file, so a task that is lost or runs twice leaves no half of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                target, own = f"{root}/{name}.warc.zst", f"{root}/_{name}.{attempt}"
                with place.open_output_stream(own, compression=None) as f:
                    f.write(data.as_buffer())
                place.move(own, target)
                out.append((name, target, len(data.as_buffer())))
            kinds = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=["bundle_id", "path", "bytes"])

    return archives.select("bundle_id", "archive").mapInArrow(run, "bundle_id string, path string, bytes long")


def imported(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle_id, archive) of the files that ``export`` wrote, for ``read``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\.warc\.zst$", 1).alias("bundle_id"), F.col("content").alias("archive"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write every row into bundles in the shared folder and read the records back."""
    return read(Written(bundles(pages, id_col, url_col, html_col, min_revisit_bytes)).df, id_col)
