"""Readers for raw log files, indexed log documents and text documents."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlogs import parse
from sessionlogs.schemas import INDEXED_DOC

log = logging.getLogger(__name__)

# Input order of a record: source, given path, file below it, split in the file, line in the split.
LINE_ORDER = ["source_idx", "file_idx", "source_file", "block_start", "line_no"]
INDEX_BUCKET = "index"
DEFAULT_SPAN = timedelta(minutes=2)


def _readable(spark: SparkSession, path: str, skip_missing: bool) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if not skip_missing or e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("log file not found, skipped: %s", path)
        return None


def scan_log_text(spark: SparkSession, paths: Sequence[str], skip_missing: bool = True) -> DataFrame:
    """Raw lines with their input order; ``paths`` may be files, folders or globs."""
    scans = [
        df.select(
            F.lit(0).alias("source_idx"),
            F.lit(i).alias("file_idx"),
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_no"),
            "value",
        )
        for i, df in enumerate(_readable(spark, p, skip_missing) for p in paths)
        if df is not None
    ]
    if not scans:
        return spark.createDataFrame(
            [],
            "source_idx int, file_idx int, source_file string, block_start bigint, line_no bigint, value string",
        )
    return reduce(DataFrame.unionByName, scans)


def service_from_path(path: Column) -> Column:
    """File name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*\z", 1)


def with_file_bucket(records: DataFrame) -> DataFrame:
    return records.withColumn("source_bucket", service_from_path(F.col("source_file")))


def bounds(start: datetime, end: datetime | None = None) -> tuple[datetime, datetime]:
    """Both ends of a range; without an end it spans two minutes. Times without a zone are in UTC."""
    return tuple(t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC) for t in (start, end or start + DEFAULT_SPAN))


def time_range(
    records: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    time: Column | None = None,
) -> DataFrame:
    """Inclusive range; without an end it spans two minutes, without a start it is not applied.

    Times without a zone are in UTC.
    """
    if end is not None and start is None:
        raise ValueError("an end time needs a start time")
    if start is None:
        return records
    start, end = bounds(start, end)
    time = F.col("ts") if time is None else time
    if "event_date" in records.columns:
        # whole days first, by partition; documents stored without days have none
        day = F.col("event_date")
        records = records.where(day.isNull() | day.between(F.lit(start.date()), F.lit(end.date())))
    return records.where(time.between(F.lit(start), F.lit(end)))


def earliest(records: DataFrame, max_results: int | None) -> DataFrame:
    """The first ``max_results`` records by time and input order; all of them by default."""
    if max_results is None:
        return records
    return records.orderBy("ts", *LINE_ORDER).limit(max_results)


def indexed_time() -> Column:
    """Time of a stored document: its value, or the text of one that was stored without it."""
    return F.coalesce("ts", F.try_to_timestamp(F.col("`@timestamp`")))


def _stored_range(docs: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Documents within the range. Days are skipped by their folders, files and row groups by the bounds of ``ts``;
    only documents without it are kept until their text is read."""
    within = time_range(docs, start, end, indexed_time())
    if start is None:
        return within
    low, high = bounds(start, end)
    return within.where(F.col("ts").isNull() | F.col("ts").between(F.lit(low), F.lit(high)))


def from_indexed(docs: DataFrame, reparse: bool = False) -> DataFrame:
    """Indexed documents to records.

    Fields are taken as stored; only documents that were stored without message fields are parsed, which is a branch of
    its own, so that others are read without their messages unless these are asked for. ``reparse`` parses
    all messages again. A stored session id stays, also where only call ids imply it.
    """
    order = {
        "source_idx": F.lit(0),
        "file_idx": F.lit(0),
        "source_file": F.lit(""),
        "block_start": F.lit(0).cast("bigint"),
        "line_no": F.monotonically_increasing_id(),
    }
    order_cols = [F.coalesce(F.col(n), c).alias(n) for n, c in order.items()]
    message = F.coalesce(F.col("message"), F.lit(""))
    stored = F.col("is_login").isNotNull()

    def fields(session: Column) -> list[Column]:
        ts = indexed_time()
        return [
            *order_cols, session.alias("session_id"), F.col("ts_raw"), ts.alias("ts"), ts.isNull().alias("ts_invalid"),
            F.col("`log.level`").alias("level"), F.col("`service.name`").alias("service"), message.alias("message"),
        ]

    if reparse:
        session = F.when(stored, F.col("session_id")).otherwise(parse.session_id(message))
        return parse.reparse(docs.select(fields(session)))
    parsed = docs.where(stored).select(*fields(F.col("session_id")), *parse.MESSAGE_FIELDS)
    return parsed.unionByName(parse.reparse(docs.where(~stored).select(fields(parse.session_id(message)))))


def scan_indexed_docs(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    max_results: int | None = None,
    fmt: str = "parquet",
    reparse: bool = False,
) -> DataFrame:
    """Structured documents written by ``sinks.write_index``, as records."""
    docs = spark.read.format(fmt).schema(INDEXED_DOC).load(path)
    records = from_indexed(_stored_range(docs, start, end), reparse)
    return earliest(records.withColumn("source_bucket", F.lit(INDEX_BUCKET)), max_results)


def scan_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Text documents directly inside ``folder``: one row per file, ``source`` is its name."""
    return (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", False)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    )
