"""Rules inferred from outputs of older versions; not part of the reference semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlogs.parse import is_error_level, keyed_value

# fixed values: thresholds of normal behaviour
NORMAL_LATENCY_MS = 200
NORMAL_ERROR_RATE = 0.01


def impact_flags(errors: DataFrame) -> DataFrame:
    """Which kinds of impact the errors of a session have."""
    kind = F.col("error_type")
    return errors.groupBy("session_id").agg(
        F.bool_or(kind == "timeout").alias("performance_impact"),
        F.bool_or(kind.isin("rate_limit", "authentication")).alias("security_impact"),
    )


def affected_components(records: DataFrame) -> DataFrame:
    """Map of the session, endpoint and transaction a record names."""
    named = F.create_map(
        F.lit("session"), F.col("session_id"),
        F.lit("endpoint"), F.col("api_endpoint"),
        F.lit("transaction"), F.col("transaction_type"),
    )
    return records.withColumn("affected_components", F.map_filter(named, lambda _, v: v.isNotNull()))


def stated_severity(message: Column, severity: Column) -> Column:
    """Severity written in the message, else the given one."""
    return F.coalesce(keyed_value(message, "severity"), severity)


def service_health(records: DataFrame) -> DataFrame:
    """Mean duration and share of error records per service, flagged beyond the normal range."""
    duration = F.col("metrics.duration_ms")
    return (
        records.groupBy("service")
        .agg(
            F.round(F.avg(duration), 6).alias("mean_duration_ms"),
            F.round(F.avg(is_error_level(F.col("level")).cast("int")), 6).alias("error_rate"),
        )
        .withColumn(
            "is_abnormal",
            F.coalesce(F.col("mean_duration_ms") >= NORMAL_LATENCY_MS, F.lit(False))
            | (F.col("error_rate") >= NORMAL_ERROR_RATE),
        )
    )
