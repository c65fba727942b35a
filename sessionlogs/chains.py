"""Error chains: the errors of a session's call tree, their severity and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlogs import calltree
from sessionlogs.objects import item, opened, pieces
from sessionlogs.parse import SEVERITIES, content_severity, is_error_level, iso_time
from sessionlogs.skew import HOT_ROWS, LIST_ITEMS, lists, sequence

BREAKDOWN = [s.lower() for s in reversed(SEVERITIES)]


def error_pool(positions: DataFrame, nodes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Errors of all nodes and their ERROR or WARN responses, in chain order, written once.

    Chain order (``chain_seq``) goes by node, then errors before the response,
    then time. Only rows with ``in_chain`` (ERROR or WARN) enter the chain itself.
    """
    cols = ["session_id", "node_urc", "attach_seq", "seq", *calltree.DETAIL]
    errors = calltree.node_errors(positions, nodes, hot_rows).select(
        *cols, F.lit(0).alias("is_node_response")
    )
    responses = calltree.node_responses(positions, nodes, errors_only=True).select(
        *cols, F.lit(1).alias("is_node_response")
    )
    pool = errors.unionByName(responses).withColumns(
        {
            "in_chain": is_error_level(F.col("level")),
            "calculated_severity": content_severity(F.col("message")),
            "error_type": F.coalesce("error_type", F.lit("unknown")),
        }
    )
    return sequence(
        pool, ["session_id", "attach_seq", "is_node_response", "seq"], "error_pool", "chain_seq"
    )


def error_struct() -> Column:
    """One error as it appears in a chain."""
    return F.struct(
        iso_time(F.col("ts")).alias("timestamp"),
        "level",
        F.col("service").alias("source"),
        "message",
        "error_type",
        "urc",
        "uid",
        "calculated_severity",
    )


def severity_counts() -> list[Column]:
    return [
        F.count_if(F.col("in_chain") & (F.col("calculated_severity") == s.upper())).alias(s)
        for s in BREAKDOWN
    ]


def impact_level() -> Column:
    """The highest severity with a count, LOW if there is none."""
    level = F.lit("LOW")
    for s in ("medium", "high", "critical"):
        level = F.when(F.col(s) > 0, s.upper()).otherwise(level)
    return level


def chain_headers(pool: DataFrame) -> DataFrame:
    """One row per session with errors: totals, severity breakdown and impact."""
    return (
        pool.groupBy("session_id")
        .agg(F.count_if("in_chain").alias("total_errors"), *severity_counts())
        .withColumn("impact_level", impact_level())
    )


def chain_errors(pool: DataFrame, size: int = LIST_ITEMS) -> DataFrame:
    """The errors of each chain that has any, in order, as one list; NULL beyond ``size``."""
    return lists(pool.where("in_chain"), ["session_id"], "chain_seq", error_struct(), "errors", size)


def error_pieces(pool: DataFrame, list_no: int) -> DataFrame:
    """The errors of each chain for ``objects.write_objects``."""
    return pieces(pool.where("in_chain"), "session_id", list_no, "chain_seq", item(error_struct()))


def trigger_errors(pool: DataFrame) -> DataFrame:
    """The first error of each chain; chains without errors have none."""
    return (
        pool.where("in_chain")
        .groupBy("session_id")
        .agg(F.min(F.struct("chain_seq", error_struct().alias("e"))).alias("t"))
        .select("session_id", "t.e.*")
    )


def sessions_with_errors(pool: DataFrame) -> DataFrame:
    return chain_headers(pool).where(F.col("total_errors") > 0).select("session_id")


def correlation_headers(nodes: DataFrame, pool: DataFrame) -> DataFrame:
    """One row per session with a call tree; chain columns are NULL without a chain."""
    roots = nodes.where(F.col("level") == 0).select(
        "session_id", F.col("urc").alias("root_urc")
    )
    return (
        roots.join(calltree.total_calls(nodes), "session_id")
        .join(chain_headers(pool), "session_id", "left")
    )


def correlation_records(nodes: DataFrame, pool: DataFrame, size: int = LIST_ITEMS) -> DataFrame:
    """Nested correlation, one row per session: calls with their children, error chain, metrics.

    A list of more than ``size`` items is NULL here, as a value of that size fits no row; ``calls``, ``nodes`` and the pool
    have its items as rows, and the files of ``correlation_objects`` have it whole.
    """
    errors = chain_errors(pool, size).withColumnRenamed("n_items", "n_errors")
    rows = calltree.calls(nodes, size).drop("total_calls").join(correlation_headers(nodes, pool), "session_id").join(errors, "session_id", "left")
    none = F.array().cast(errors.schema["errors"].dataType)
    listed = F.when(F.col("n_errors").isNull(), none).otherwise(F.col("errors"))
    chain = F.struct("session_id", listed.alias("errors"), "total_errors", "impact_level", F.struct(*BREAKDOWN).alias("severity_breakdown"))
    return rows.select(
        "session_id",
        "root_urc",
        "api_calls",
        F.filter(F.array(F.when(F.col("total_errors").isNotNull(), chain)), lambda c: c.isNotNull()).alias("error_chains"),
        F.struct("total_calls").alias("metrics"),
    )


def correlation_objects(nodes: DataFrame, pool: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The same as marks and pieces for ``objects.write_objects``, at any size."""
    head = F.concat(opened(F.struct("session_id", "root_urc", F.struct("total_calls").alias("metrics"))), F.lit(',"api_calls":['))
    chain = opened(F.struct("session_id", "total_errors", "impact_level", F.struct(*BREAKDOWN).alias("severity_breakdown")))
    found = F.col("total_errors").isNotNull()
    middle = F.concat(F.lit('],"error_chains":['), F.when(found, F.concat(chain, F.lit(',"errors":['))).otherwise(""))
    end = F.when(found, "]}]}").otherwise("]}")
    marks = correlation_headers(nodes, pool).select("session_id", F.array(head, middle, end).alias("marks"))
    return marks, calltree.call_pieces(nodes, 0, hot_rows).unionByName(error_pieces(pool, 1))
