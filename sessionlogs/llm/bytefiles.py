"""Files of raw bytes, written and read by Spark's own sources.

The text writer puts a row's bytes into the file as they are and ends each row with a line separator. With
a zero byte as separator, a stream that ends in a zero byte can be cut after zero bytes and written exactly: the
separators stand for the bytes at the cuts. So any file system and the commit protocol of Spark's writers apply,
and a lost or repeated task leaves no partial file. One file per partition, in the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def cut(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Rows for the writer: the stream without the zero bytes at the cuts. It must end with a zero byte."""
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= BATCH_BYTES:
            whole = b"".join(held)
            end = whole.rfind(b"\0")
            if end >= 0:
                yield whole[:end]
                whole = whole[end + 1 :]
            held, size = [whole], len(whole)
    whole = b"".join(held)
    if whole:
        if whole[-1]:
            raise ValueError("the stream must end with a zero byte")
        yield whole[:-1]


def write(rows: DataFrame, path: str) -> None:
    """Writes the one binary column of ``rows``, made by ``cut``, as a file for each partition."""
    (name,) = rows.columns
    rows.select(F.col(name).cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``content`` of each file that isn't empty."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
