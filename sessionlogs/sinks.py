"""Writers for indexed documents and analysis results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlogs import chains, rootcause
from sessionlogs.objects import PART_PIECES, write_objects
from sessionlogs.parse import iso_time, route, utc_clock
from sessionlogs.sources import LINE_ORDER


def to_indexed(records: DataFrame, *more: str) -> DataFrame:
    """Records under the field names of an index, absent values as NULL, with columns ``more``."""
    return records.select(
        *more,
        iso_time(F.col("ts")).alias("@timestamp"),
        F.col("level").alias("log.level"),
        F.col("service").alias("service.name"),
        "message",
        "is_login",
        "is_request",
        "is_response",
        "session_id",
        "urc",
        "uid",
        "cif_id",
        "transaction_type",
        "api_endpoint",
        "error_type",
        "severity",
        "metrics",
        *LINE_ORDER,
        F.when(F.col("ts").isNull(), F.col("ts_raw")).alias("ts_raw"),
        "ts",
        utc_clock(F.col("ts")).cast("date").alias("event_date"),
    )


def write_index(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append records, one folder per day, its files by ranges of time.

    Files and their row groups then hold narrow ranges of ``ts``, which readers skip by their bounds. Input order stands
    behind the time, so that one second with very many records is split over files too.
    """
    order = ["event_date", "ts", *LINE_ORDER]
    (
        to_indexed(records)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("append")
        .partitionBy("event_date")
        .format(fmt)
        .save(path)
    )


def write_routed_lines(lines: DataFrame, path: str) -> None:
    """Raw lines to one text folder per service route."""
    (
        lines.select(route(F.col("value")).alias("route"), "value")
        .hint("rebalance", "route")
        .write.mode("append")
        .partitionBy("route")
        .text(path)
    )


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows that have a ``session_id`` as JSON lines, those of a session together; a large one is split over several files."""
    rows.hint("rebalance", "session_id").write.mode("append").option("ignoreNullFields", False).json(path)


def write_full_analysis(nodes: DataFrame, pool: DataFrame, path: str, folder_per_session: bool = False, most: int = PART_PIECES) -> None:
    """The correlation of each session as one JSON object, without root causes, however many calls and errors it has."""
    write_objects(*chains.correlation_objects(nodes, pool), "session_id", path, most, folder_per_session)


def write_root_causes(
    nodes: DataFrame, pool: DataFrame, path: str, model_output: DataFrame | None = None, folder_per_session: bool = False, most: int = PART_PIECES
) -> None:
    """``{session_id, timestamp, root_causes[]}`` as one JSON object for each session that has a trigger."""
    write_objects(*rootcause.root_cause_objects(nodes, pool, model_output), "session_id", path, most, folder_per_session)
