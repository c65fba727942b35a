"""Log lines derived from the ``events`` table: each user is a session, call n's parent is n/2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlogs.skew import ranked, sequence

# --- fixed values: text of the derived lines ---
DETAILS = [
    "Database cluster unavailable - all nodes down",
    "Gateway timeout",
    "Data validation failed - missing required fields",
    "Authentication token expired",
    "Rate limit exceeded",
    "Connection pool exhausted",
    "Insufficient permissions",
    "Unexpected business rule",
]
STATUS_CODES = [500, 422, 401, 403, 400]
# --- end of fixed values ---


def numbered_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``n``, their 1-based position within the user by time and id."""
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "user_id", "ts", "event_id", "event_type", "value"
    )
    ordered = sequence(events, ["user_id", "ts", "event_id"], "events")
    return ranked(ordered, ["user_id"], "seq", "n")


def _call_id(n: Column, sid: Column) -> Column:
    return (
        F.when(n <= 1, F.concat(F.lit("urc-root-"), sid))
        .when(n % 13 == 0, F.concat(F.lit("urc-evt-req-db-"), sid, F.lit("-"), n.cast("string")))
        .otherwise(F.concat(F.lit("urc-evt-req-"), sid, F.lit("-"), n.cast("string")))
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One login per user, then a request and a response per event, some with extra lines.

    Users differ: some have no login, some no errors above INFO, some only mild ones; some times are no times.
    """
    n, kind = F.col("n"), F.col("event_type")
    sid = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    calm, mild, login = (F.col("user_id") % 5 == 3), (F.col("user_id") % 5 == 4), (F.col("user_id") % 11 != 5)
    level = (
        F.when(calm, "INFO")
        .when(kind == "error", "ERROR")
        .when((kind == "signup") & (n % 5 == 0), "WARN")
        .otherwise("INFO")
    )
    detail = F.when(mild, DETAILS[2]).otherwise(F.element_at(F.array(*map(F.lit, DETAILS)), (n % 8 + 1).cast("int")))
    code = F.when((kind == "error") & mild, 422).when(
        kind == "error", F.element_at(F.array(*map(F.lit, STATUS_CODES)), (n % 5 + 1).cast("int"))
    ).otherwise(200)
    late = (n % 11 == 0) & (n > 1)
    when = F.when(late, F.expr("ts + interval 10 day")).otherwise(F.col("ts"))
    base = numbered_events(spark, folder).select(
        "user_id",
        "n",
        kind,
        "value",
        sid.alias("sid"),
        level.alias("lvl"),
        detail.alias("det"),
        code.cast("string").alias("code"),
        F.when((n % 29 == 0) & ~login, "no time").otherwise(F.substring(when.cast("string"), 1, 19)).alias("rt"),
        _call_id(n, sid).alias("urc"),
        _call_id(F.floor(n / 2), sid).alias("uid"),
    )

    def line(seq: int, cond: Column, *parts: Column | str) -> Column:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.when(cond, F.struct(F.lit(seq).alias("seq"), text.alias("value")))

    rt, urc, uid, det = (F.col(c) for c in ("rt", "urc", "uid", "det"))
    call = n > 1
    request = (
        "[", rt, "] [INFO] svc_", kind, ": Request received for /api/v1/", kind,
        ", URC=", urc, ", UID=", uid, ", transaction_type=", kind,
    )
    lines = [
        line(0, (n == 1) & login, "[", rt, "] [INFO] api_gateway: User 'user_", F.col("user_id").cast("string"),
             "' logged in session_id=", F.col("sid"), " cif_id=",
             (F.col("user_id") + 100000).cast("string"), " URC=", urc),
        line(1, call, *request),
        line(2, call, "[", rt, "] [", F.col("lvl"), "] svc_", kind, ": Response sent for /api/v1/", kind,
             ", URC=", urc, ", UID=", uid, ", status_code=", F.col("code"), ", duration: ",
             F.floor("value").cast("string"),
             F.when(F.col("lvl") == "INFO", "").otherwise(F.concat(F.lit(", error_details="), det))),
        line(3, call & (n % 7 == 0) & ~calm, "[", rt, "] [ERROR] svc_", kind, ": Downstream failed, ",
             F.when(n % 2 == 0, F.concat(F.lit("URC="), urc, F.lit(", "))).otherwise(""),
             "UID=", uid, ", endpoint=/api/v1/", kind, ", reason=", det),
        line(4, call & (n % 17 == 0), *request),
        line(5, n % 23 == 0, "malformed line without brackets ", n.cast("string")),
    ]
    return base.select("user_id", "n", F.explode(F.array_compact(F.array(*lines))).alias("l")).select(
        F.lit(0).alias("source_idx"),
        F.lit(0).alias("file_idx"),
        F.lit("events").alias("source_file"),
        F.lit(0).cast("bigint").alias("block_start"),
        (F.col("user_id").cast("bigint") * F.lit(10**10) + F.col("n") * 10 + F.col("l.seq")).alias("line_no"),
        F.col("l.value").alias("value"),
    )
