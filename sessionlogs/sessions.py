"""Grouping records into sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlogs import parse
from sessionlogs.skew import SEGMENT_ROWS, segments, sequence
from sessionlogs.sources import LINE_ORDER


def order_time() -> Column:
    """Time to sort by: records without one come first, at the epoch."""
    return F.coalesce(F.col("ts"), F.timestamp_seconds(F.lit(0)))


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Records of several sources together, in the order given; each keeps its ``source_bucket``."""
    marked = [df.withColumn("source_idx", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def with_session(records: DataFrame) -> DataFrame:
    return records.where(F.col("session_id").isNotNull())


def deduplicated(records: DataFrame) -> DataFrame:
    """The first record of every (session, bucket, time, message, service), with its ``copies``.

    A plain aggregate, so copies are merged before the shuffle. The fields that follow
    from message and level are left out; ``positions`` reads them again.
    """
    keys = ["session_id", "source_bucket", "ts", "_bad_ts", "message", "service"]
    first = F.min(F.struct(*LINE_ORDER, "level", "ts_invalid"))
    return (
        with_session(records)
        .withColumn("_bad_ts", F.when(F.col("ts").isNull(), F.col("ts_raw")))
        .groupBy(*keys)
        .agg(first.alias("_first"), F.count(F.lit(1)).alias("copies"))
        .select("*", "_first.*")
        .drop("_first")
        .withColumnRenamed("_bad_ts", "ts_raw")
    )


def positions(records: DataFrame) -> DataFrame:
    """Deduplicated records with ``seq``, increasing by time and input order in each session."""
    rows = deduplicated(records).withColumn("order_ts", order_time())
    order = ["session_id", "order_ts", *LINE_ORDER, "source_bucket"]
    return sequence(rows, order, "positions", then=parse.reparse)


def session_counts(records: DataFrame) -> DataFrame:
    """Records per session and bucket."""
    return (
        with_session(records)
        .groupBy("session_id", "source_bucket")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def dedup_counts(positions: DataFrame) -> DataFrame:
    """Records per session before and after removing duplicates."""
    return positions.groupBy("session_id").agg(
        F.sum("copies").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
    )


def log_content(positions: DataFrame, size: int = SEGMENT_ROWS, by_input_order: bool = False) -> DataFrame:
    """Messages of each session and bucket, one per line, by time or by their order in the input.

    Up to ``size`` messages are one text (segment 0); longer ones continue in further segments.
    """
    keys = ["session_id", "source_bucket"]
    if by_input_order:
        positions = sequence(positions.drop("seq"), [*keys, *LINE_ORDER], "input_order")
    lists = segments(
        positions, keys, "seq", F.col("message"), "messages", size
    )
    return lists.withColumn("content", F.array_join("messages", "\n")).drop("messages")
