"""WARC archives: a writer, and a sequential reader with digest verification.

Every record is a gzip member of its own. Of records with equal payloads, the one with the largest id is a
response; smaller ones are revisits that refer to it and carry no payload. An archive (a partition) begins with a
``warcinfo`` record and ends with a ``metadata`` record that counts the others.

The reader inflates each member incrementally with zlib, frames the block by its content length, compares it with
the member's end, and computes the payload's SHA-1 again. What doesn't fit is reported in ``error``; an archive
that can't be read on ends with such a row, so damage isn't silent.

Defined cases: a NULL payload is an empty one; a NULL url has no target header; a NULL id stays NULL and is never
referred to; rows that share the largest id are all responses. Payloads of any length are whole. Extra columns are left out. An
empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlogs.llm import bytefiles
from sessionlogs.stage import materialise

DATE = "1970-01-01T00:00:00Z"
#: Payloads with more than this share of all copies are joined apart.
HOT_SHARE = 1000
#: Bytes fed to zlib at once.
STEP = 1 << 16
BATCH_BYTES = 8 << 20

SCHEMA = pa.schema(
    [
        ("archive", pa.string()), ("record_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)
_SPARK_SCHEMA = "archive string, record_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n") + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def _urn(record_id: int | None) -> str:
    return f"<urn:page:{'none' if record_id is None else record_id}>"


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    n = 0
    for batch in batches:
        for record_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to")), strict=True):
            record_id, refers_to, url, body = record_id.as_py(), refers_to.as_py(), url.as_py(), payload.as_py() or b""
            if not n:
                yield member([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", "<urn:archive>")], b"format: WARC/1.1\r\n")
            n += 1
            headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", DATE), ("WARC-Record-ID", _urn(record_id))]
            if url is not None:
                headers.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
            headers += [("WARC-Payload-Digest", f"sha1:{digest(body)}"), ("X-Payload-Length", str(len(body)))]
            if refers_to is not None:
                headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
                body = b""
            yield member(headers, body)
    if n:
        yield member([("WARC-Type", "metadata"), ("WARC-Date", DATE), ("WARC-Record-ID", "<urn:archive:end>")], f"records: {n}\r\n".encode())


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in bytefiles.cut(_records(batches)):
        yield pa.record_batch([pa.array([row], pa.binary())], names=["bytes"])


def _with_last(rows: DataFrame) -> DataFrame:
    """Adds ``last``, the largest id with the payload, for payloads that stand more than once.

    Fewer than HOT_SHARE payloads can hold over 1 / HOT_SHARE of the copies each, so those are broadcast; their rows are
    then dealt out by id, and the join with all other payloads has no heavy key.
    """
    groups = rows.groupBy("sha").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    copies = materialise(groups.where((F.col("n") > 1) & F.col("last").isNotNull()), "warc_copies")
    limit = (copies.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = copies.where(F.col("n") > limit).select("sha", F.col("last").alias("hot_last"))
    rest = copies.where(F.col("n") <= limit).select(F.col("sha").alias("key"), "last")
    rows = rows.join(F.broadcast(hot), "sha", "left")
    rows = rows.withColumn("key", F.when(F.col("hot_last").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("id"))))
    return rows.join(rest, "key", "left").withColumn("last", F.coalesce("hot_last", "last"))


def write(df: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes an archive for each partition below ``path``."""
    rows = df.select(F.col(record_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    rows = _with_last(rows)
    rows = rows.withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("id") < F.col("last")), F.col("last")))
    rows = rows.select("id", "url", "payload", "refers_to")
    bytefiles.write(rows.mapInArrow(_write, "bytes binary"), path)


def members(content: memoryview) -> Iterator[tuple[bytes, str | None]]:
    """Inflated members in turn, each with what is wrong with it."""
    at = 0
    while at < len(content):
        z, parts = zlib.decompressobj(31), []
        try:
            while not z.eof and at < len(content):
                step = content[at : at + STEP]
                parts.append(z.decompress(step))
                at += len(step) - len(z.unused_data)
        except zlib.error as e:
            yield b"".join(parts), f"damaged member: {e}"
            return
        yield b"".join(parts), None if z.eof else "truncated member"


_ID = re.compile(r"<urn:page:(-?\d+)>")


def _number(text: str | None) -> int | None:
    m = _ID.fullmatch(text or "")
    return int(m[1]) if m else None


def record(data: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers, block and error of an inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not lines[0].startswith("WARC/") or not length.isascii() or not length.isdigit():
        return headers, b"", "not a record"
    block, end = rest[: int(length)], rest[int(length) :]
    return headers, block, None if len(block) == int(length) and end == b"\r\n\r\n" else "content length doesn't fit"


def rows(archive: str, content: memoryview) -> Iterator[dict]:
    """The page records of one archive in order, and a row for anything that is wrong with it."""
    n, ended = 0, not len(content)
    bad = dict.fromkeys(SCHEMA.names) | {"archive": archive}
    for data, error in members(content):
        if error:
            yield bad | {"error": error}
            return
        headers, block, error = record(data)
        kind = headers.get("warc-type")
        if kind == "warcinfo" and not error:
            continue
        if kind == "metadata" and not error:
            ended = True
            if block != b"records: %d\r\n" % n:
                yield bad | {"error": "records are missing"}
            continue
        n += 1
        stated, length = headers.get("warc-payload-digest", "").removeprefix("sha1:"), headers.get("x-payload-length", "")
        if not error and kind == "response" and (digest(block) != stated or str(len(block)) != length):
            error = "digest doesn't fit"
        yield {
            "archive": archive, "record_id": _number(headers.get("warc-record-id")), "record_type": kind,
            "url": unquote(headers["warc-target-uri"]) if "warc-target-uri" in headers else None,
            "refers_to": _number(headers.get("warc-refers-to")), "payload_bytes": int(length) if length.isdigit() else len(block),
            "payload_digest": stated, "payload": block if kind == "response" else None, "error": error,
        }
    if not ended:
        yield bad | {"error": "the end record is missing"}


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            held, size = [], 0
            for row in rows(path.as_py(), memoryview(content.as_buffer())):
                held.append(row)
                size += len(row["payload"] or b"") + 300
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per page record of the archives below ``path``, with payload and error."""
    return bytefiles.read(spark, path).mapInArrow(_read, _SPARK_SCHEMA)
