import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from sessionlogs.llm import warc

PAGES = "page_id long, url string, html string"


def test_round_trip_with_revisits(spark, tmp_path):
    rows = [(1, "http://a/é?x=1 2", "same"), (2, None, "same"), (3, "http://b", "same"), (3, "http://c", "same"), (4, "u\r\nX: y", None), (5, "u", ""), (None, "n", "null id"), (6, "u", "\0\r\n\r\nWARC/1.1" * 3), (7, "u", "漢" * 400_000), (8, "u", "only")]
    df = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).repartition(3)
    path = str(tmp_path / "w")
    warc.write(df, path)
    out = warc.read(spark, path).collect()
    assert len(out) == len(rows) and not any(r.error for r in out)
    for page_id, url, html in rows:
        body = (html or "").encode()
        r = next(r for r in out if r.record_id == page_id and r.url == url)
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        last = {"same": 3, None: 5}.get(html, page_id)
        if last == page_id or page_id is None:
            assert (r.record_type, r.refers_to, r.payload) == ("response", None, body)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", last, None)


def test_other_readers_open_the_archives(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "x")], PAGES), str(tmp_path / "w"))
    (data,) = [p.read_bytes() for p in (tmp_path / "w").glob("part-*") if p.stat().st_size]
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == 3 and b"\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" in text


def test_damage_is_reported():
    good = [warc.member([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Payload-Digest", f"sha1:{warc.digest(b'abc')}"), ("X-Payload-Length", "3")], b"abc"), warc.member([("WARC-Type", "metadata")], b"records: 1\r\n")]

    def errors(data):
        return [r["error"] for r in warc.rows("x", memoryview(data))]

    assert errors(b"".join(good)) == [None]
    assert errors(good[0]) == [None, "the end record is missing"]
    assert errors(good[0][:-9]) == ["truncated member"]
    assert errors(b"junk")[0].startswith("damaged member")
    other = warc.member([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Payload-Digest", "sha1:AAAA"), ("X-Payload-Length", "3")], b"abc")
    assert errors(other + good[1]) == ["digest doesn't fit"]
    assert errors(good[1]) == ["records are missing"]
    assert errors(b"") == []


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0
