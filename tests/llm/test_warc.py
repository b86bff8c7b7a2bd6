import io
import uuid

import zstandard
from pyspark.sql import functions as F

from spanforge.llm import warc


class _Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_bundle_is_seekable_and_plain_zstandard():
    kept = _Bytes()
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = warc.BundleWriter(sink, frame_bytes=300)
    rows = [(k, f"http://x/{k}", bytes([65 + k]) * (k * 40), None if k % 3 else 2) for k in range(9)]
    places = [writer.add(warc.record(*r)) for r in rows]
    writer.close()
    kept = _Bytes(sink.getvalue())
    reader = warc.BundleReader(kept)
    assert len(reader.frames) > 2 and len({f for f, _ in places}) == len(reader.frames)
    for (page, url, payload, refers), (frame, at) in zip(rows, places, strict=True):
        fields, head, body, _ = warc.parse(reader.frame(frame), at)
        assert fields["WARC-Record-ID"] == f"<urn:page:{page}>" and fields["WARC-Target-URI"] == url
        assert body == (payload if refers is None else b"") and f"Content-Length: {len(payload)}".encode() in head
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(kept.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(reader.frame(k) for k in range(len(reader.frames)))


def test_archives(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 500, "<p>b</p>"]
    rows = spark.createDataFrame([(k, f"http://h/{k}\r\nX: 1", h, "p") for k, h in enumerate(html)] + [(4, "u", "é" * 500, "p"), (None, None, "<p>a</p>", "p")], "page_id long, url string, html string, payload string").repartition(3)
    index = warc.write_archives(warc.with_revisits(rows), f"{tmp_path}/{uuid.uuid4().hex}", frame_bytes=400, bundle_bytes=200)
    bundles = index.select("bundle").distinct()
    read = warc.read_archives(bundles)
    assert read.select(F.spark_partition_id()).distinct().count() == bundles.count() > 2  # a task for each
    found = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in read.collect()), key=str)
    assert found == sorted([(0, "revisit", 1, 8), (1, "response", None, 8), (2, "revisit", 3, 0), (3, "response", None, 0), (4, "response", None, 1000), (4, "response", None, 1000), (5, "response", None, 8), (None, "revisit", 1, 8)], key=str)
    one = warc.fetch(index.where("page_id = 5")).collect()
    assert [bytes(r.payload) for r in one] == [b"<p>b</p>"] and one[0].payload_digest == warc.base32_sha1(b"<p>b</p>")
    assert warc.write_archives(warc.with_revisits(rows.limit(0)), f"{tmp_path}/none").count() == 0
    small = warc.with_revisits(rows, min_bytes=9).where(F.col("refers_to").isNotNull())
    assert small.count() == 0


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    expected = sorted(duckdb.sql(f"SELECT {', '.join(columns)} FROM ({warc.OP8_SQL})").limit(10**9).fetchall())
    assert sorted(tuple(r) for r in warc.op8_warc(spark, sf).select(*columns).collect()) == expected
