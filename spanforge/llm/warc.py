"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table in a skippable frame (compressed and plain
size of each frame); the index maps a record's id to bundle, frame and offset within the frame. Bundles are written by the
executors straight into the shared store (pyarrow's file systems: file, hdfs, s3, gs), one or more per task and attempt, so
that a task that runs again writes another bundle and the index, committed by Spark, names only those that count.

Null payloads are empty; a null id is written as such and never becomes a target of revisits. Rows that repeat an id and
payload are written once each. Empty input: no bundles, an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_root, small_batches, staged, table, task_id

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
#: Tasks that read bundles side by side, at most; further bundles share them.
MOST_READERS = 10_000
#: Fixed values of the seekable format: skippable-frame magic, footer magic.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload or, where it refers to another record, a revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """The record that starts at `at`: its fields, HTTP head and payload, and where the next one starts."""
    end = plain.index(b"\r\n\r\n", at)
    first, *lines = plain[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(fields["Content-Length"])
    head, _, payload = plain[start:stop].partition(b"\r\n\r\n")
    return fields, head, payload, stop + 4


class BundleWriter:
    """Writes records into frames of about `frame_bytes`, then the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.most = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in its plain bytes) of the record. The seek table's sizes have 32 bits."""
        if len(data) >> 32:
            raise ValueError("a record of 4 GiB or more doesn't fit in a frame")
        if (self.size + len(data)) >> 32:
            self._flush()
        place = len(self.frames), self.size
        self.pending.append(data)
        self.size += len(data)
        if self.size >= self.most:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.pending:
            packed = self.zstd.compress(b"".join(self.pending))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Random access by frame: reads the footer, then only the bytes of the frames asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        table = source.read_at(count * entry, size - 9 - count * entry)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=plain)

    def records(self) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
        for k in range(len(self.frames)):
            plain, at = self.frame(k), 0
            while at < len(plain):
                fields, head, payload, after = parse(plain, at)
                yield k, at, fields, head, payload
                at = after


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least `min_bytes` that with the largest id stays, others refer to it.

    Groups are found on digests alone, and digest and id together say to which page a reference goes: payloads are not
    dealt by digest, so pages that share one payload don't meet in one task.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    digests = rows.select("page_id", "digest").where(F.length("payload") >= min_bytes)
    kept = digests.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL").select("digest", "largest")
    # One row per id and digest: repeated rows get the same answer.
    revisits = digests.distinct().join(kept, "digest").where(~F.col("page_id").eqNullSafe(F.col("largest"))).select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("largest").alias("refers_to"))
    same = F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    return rows.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")


INDEX = "page_id long, bundle string, frame long, at long"


def write_archives(records: DataFrame, uri: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) as bundles below `uri`; returns the committed index."""
    def write(batches):
        store, folder = _store(uri)
        store.create_dir(folder, recursive=True)
        writer, path, rows = None, "", []
        for batch in batches:
            for page, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if writer is None:
                    name = f"part-{task_id():05d}-{uuid.uuid4().hex}.warc.zst"
                    path = f"{uri}/{name}"
                    writer = BundleWriter(store.open_output_stream(f"{folder}/{name}", compression=None), frame_bytes)
                rows.append((page, path, *writer.add(record(page, url, payload, refers_to))))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "at"])
                rows = []
        if writer is not None:
            writer.close()

    return staged(records.mapInArrow(write, INDEX), "warc-index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())


def _read(fields: dict[str, str], head: bytes, payload: bytes, with_payload: bool) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    return _page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], payload if with_payload else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])


def _dealt(df: DataFrame, number: int, *by: str) -> DataFrame:
    """`df` over `number` tasks; that many are kept, however small the rows are."""
    return df.repartition(max(1, number), *by)


def read_archives(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles in column `bundle`, each payload checked against its digest; a task reads a few frames at a time.

    A row of `bundles` is read on its own: bundles are dealt over as many tasks as there are, up to MOST_READERS.
    """
    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _store(path)
                with store.open_input_file(name) as source:
                    rows = []
                    for _, _, fields, head, payload in BundleReader(source).records():
                        rows.append(_read(fields, head, payload, with_payload))
                        if len(rows) == 1024 or (with_payload and len(payload) > FRAME_BYTES):
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    bundles = bundles.select("bundle")
    return _dealt(bundles, min(MOST_READERS, bundles.count())).mapInArrow(read, RECORDS)


def fetch(index: DataFrame) -> DataFrame:
    """The records that the given rows of an index point at. Rows are dealt by bundle and sorted by frame, so that a task opens
    a bundle and its seek table once and reads each frame that is asked for once."""
    def read(batches):
        held, source, reader, frame, plain = None, None, None, None, b""
        for batch in batches:
            for path, number, at in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "at")), strict=True):
                if path != held:
                    if source is not None:
                        source.close()
                    store, name = _store(path)
                    held, source, frame = path, store.open_input_file(name), None
                    reader = BundleReader(source)
                if number != frame:
                    frame, plain = number, reader.frame(number)
                fields, head, payload, _ = parse(plain, at)
                yield _batch([_read(fields, head, payload, True)])
        if source is not None:
            source.close()

    rows = index.select("bundle", "frame", "at")
    return rows.repartition("bundle").sortWithinPartitions("bundle", "frame", "at").mapInArrow(read, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    index = write_archives(with_revisits(table(spark, sf_dir, "pages")), f"{shared_root(spark)}/warc-{uuid.uuid4().hex}")
    return read_archives(index.select("bundle").distinct(), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, sha1(h) AS x FROM p),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, x,
        list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (1 + (((strpos('0123456789abcdef', x[5 * (i // 4) + 1]) - 1) * 65536 + (strpos('0123456789abcdef', x[5 * (i // 4) + 2]) - 1) * 4096
              + (strpos('0123456789abcdef', x[5 * (i // 4) + 3]) - 1) * 256 + (strpos('0123456789abcdef', x[5 * (i // 4) + 4]) - 1) * 16
              + (strpos('0123456789abcdef', x[5 * (i // 4) + 5]) - 1)) // CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END) % 32), 1)), 'string_agg', '') AS payload_digest
      FROM s)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY x) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER (PARTITION BY x) THEN max(page_id) OVER (PARTITION BY x) END AS refers_to
FROM d
"""
