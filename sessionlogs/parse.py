"""Line and message parsing as column expressions.

Patterns use (?U) for Unicode white space and digits. Regular expressions run
only on texts that contain the key they look for, and each result is projected
once before it is used again, so no expression is evaluated twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: patterns, word lists and labels that decide the results ---
SPACE = r"\s\x1C-\x1F"
LINE = rf"(?dU)^[{SPACE}]*\[(.*?)\] \[(.*?)\] (.*?): (.*[^{SPACE}]).*"
SESSION_IN_CALL_ID = r"(?U)urc-[^-]+-[^-]+-([a-z0-9]+)-\d+"
DURATION = r"(?idU)duration[:" + SPACE + r"]+(\d+)"
ERROR_LEVELS = ["ERROR", "WARN"]
ERROR_WORDS = ["error", "failed"]
ERROR_TYPES = {
    "timeout": "timeout",
    "rate limit": "rate_limit",
    "authentication": "authentication",
    "connection": "connection",
    "validation": "validation",
    "business": "business",
}
CRITICAL_PHRASES = [
    "database cluster unavailable", "all nodes down", "data corruption detected",
    "emergency fallback failed", "backup systems offline", "critical database error",
    "system failure", "catastrophic", "total system", "complete failure",
    "service unavailable", "cluster down", "infrastructure failure",
]
HIGH_PHRASES = [
    "connection pool exhausted", "database deadlock detected", "gateway timeout",
    "upstream service unavailable", "authentication failed", "database authentication failed",
    "status_code=50", "status_code=503", "status_code=504", "status_code=401",
    "timeout", "deadlock", "constraint violation", "transaction rollback",
    "resource locked", "maintenance mode",
]
MEDIUM_PHRASES = [
    "status_code=422", "validation failed", "missing required fields",
    "internal server error", "status_code=400", "bad request",
]
FALLBACK_TYPES = [
    (["timeout"], "timeout"),
    (["auth", "credentials"], "authentication"),
    (["rate limit"], "rate_limit"),
    (["connection"], "connection"),
    (["queue"], "queue"),
    (["performance", "latency"], "performance"),
]
ROUTES = [(["api_gateway", "3scale"], "gateway"), (["payment", "order"], "payment")]
DEFAULT_ROUTE = "tibco"
# --- end of fixed values ---

SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in phrases])


def _extract(text: Column, pattern: str, hint: str) -> Column:
    """First group or NULL, for a group that cannot be empty; ``hint`` is in every match."""
    return F.nullif(F.when(text.contains(hint), F.regexp_extract(text, pattern, 1)), F.lit(""))


def keyed_value(message: Column, key: str) -> Column:
    """Value of ``key=value`` up to a comma or white space."""
    return _extract(message, rf"(?U){key}=([^,{SPACE}]+)", f"{key}=")


def timestamp_from(text: Column) -> Column:
    """Second-resolution time, NULL if the text is not one. Single digits are accepted.

    The text is a time in UTC, whatever the time zone of the session.
    """
    loose = rf"(?U)^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[{SPACE}]+[0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}\z"
    clean = F.regexp_replace(text, rf"(?U)[{SPACE}]+", " ")
    return F.coalesce(
        F.when(F.length(text) == 19, F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX"))),
        F.when(text.rlike(loose), F.try_to_timestamp(F.concat(clean, F.lit("Z")), F.lit("yyyy-M-d H:m:sX"))),
    )


def utc_clock(ts: Column) -> Column:
    """The time as a clock in UTC shows it, in whole seconds and without a zone."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return epoch + F.make_dt_interval(secs=F.unix_seconds(ts))


def iso_time(ts: Column) -> Column:
    return F.concat(F.translate(utc_clock(ts).cast("string"), " ", "T"), F.lit("Z"))


def session_from_call_id(call_id: Column) -> Column:
    return _extract(call_id, SESSION_IN_CALL_ID, "urc-")


def session_id(message: Column, infer: bool = True) -> Column:
    """Explicit session id, else (``infer``) the one inside URC, else inside UID."""
    explicit = keyed_value(message, "session_id")
    if not infer:
        return explicit
    return F.coalesce(
        explicit,
        session_from_call_id(keyed_value(message, "URC")),
        session_from_call_id(keyed_value(message, "UID")),
    )


def is_login(message: Column) -> Column:
    return F.lower(message).contains("logged in")


def is_request(message: Column) -> Column:
    return F.lower(message).contains("request received")


def is_response(message: Column) -> Column:
    return ~is_request(message) & F.lower(message).contains("response sent")


def is_error_level(level: Column) -> Column:
    return F.coalesce(F.upper(level).isin(ERROR_LEVELS), F.lit(False))


def is_error(message: Column, level: Column) -> Column:
    return is_error_level(level) | contains_any(F.lower(message), ERROR_WORDS)


def error_type(message: Column, level: Column) -> Column:
    """First matching type word of an error record, NULL for other records."""
    text = F.lower(message)
    kind = F.when(~is_error(message, level), None)
    for word, name in ERROR_TYPES.items():
        kind = kind.when(text.contains(word), name)
    return kind.when(is_error_level(level), "system").otherwise("unknown_error")


def level_severity(level: Column) -> Column:
    return F.when(F.upper(level) == "ERROR", "HIGH").when(F.upper(level) == "WARN", "MEDIUM")


def duration_ms(message: Column) -> Column:
    found = F.regexp_extract(message, DURATION, 1)
    return F.when(F.lower(message).contains("duration"), F.nullif(found, F.lit(""))).try_cast("bigint")


def content_severity(message: Column) -> Column:
    """Severity by the phrases in the message; the first tier that matches wins."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(contains_any(text, CRITICAL_PHRASES), "CRITICAL")
        .when(contains_any(text, HIGH_PHRASES), "HIGH")
        .when(contains_any(text, MEDIUM_PHRASES), "MEDIUM")
        .otherwise("LOW")
    )


def fallback_error_type(message: Column, known: Column) -> Column:
    """Type guessed from the message where the known one is missing or ``unknown``."""
    text = F.lower(message)
    known = F.coalesce(known, F.lit("unknown"))
    kind = F.when(known != "unknown", known)
    for words, name in FALLBACK_TYPES:
        kind = kind.when(contains_any(text, words), name)
    return kind.otherwise(known)


def route(line: Column) -> Column:
    """Service file a raw line belongs to."""
    kind = F.lit(DEFAULT_ROUTE)
    for words, name in reversed(ROUTES):
        kind = F.when(contains_any(line, words), name).otherwise(kind)
    return kind


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters will use.

    A filter on a plain column is pushed below its projection and repeats the
    whole expression; the explode of a one-element list keeps it above.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


#: The fields that ``with_message_fields`` adds.
MESSAGE_FIELDS = [
    "is_login", "is_request", "is_response", "urc", "uid", "cif_id", "transaction_type", "api_endpoint", "error_type", "severity", "metrics",
]


def with_message_fields(records: DataFrame, infer_session: bool | None = None) -> DataFrame:
    """Add the fields held in ``message`` and ``level``; absent ones are NULL.

    ``session_id`` is added only if ``infer_session`` says how: from an explicit
    id alone, or else from the call ids as well.
    """
    m, lvl = F.col("message"), F.col("level")
    fields = {
        "is_login": is_login(m),
        "is_request": is_request(m),
        "is_response": is_response(m),
        "urc": keyed_value(m, "URC"),
        "uid": keyed_value(m, "UID"),
        "cif_id": keyed_value(m, "cif_id"),
        "transaction_type": keyed_value(m, "transaction_type"),
        "api_endpoint": keyed_value(m, "endpoint"),
        "error_type": error_type(m, lvl),
        "severity": level_severity(lvl),
        "metrics": F.struct(duration_ms(m).alias("duration_ms")),
    }
    if infer_session is None:
        return records.withColumns(fields)
    out = records.withColumns({**fields, "_explicit": keyed_value(m, "session_id")})
    call_ids = [F.col("urc"), F.col("uid")] if infer_session else []
    session = F.coalesce("_explicit", *map(session_from_call_id, call_ids))
    return evaluated_once(out, "session_id", session).drop("_explicit")


def split_lines(lines: DataFrame) -> DataFrame:
    """Raw lines ``[time] [level] service: message`` to their parts; other lines are dropped.

    White space around the line is ignored. A part cannot contain a newline, so that
    separates the parts. A value of several lines, which a table may have, counts by its first one.
    """
    order = [c for c in lines.columns if c != "value"]
    first = F.substring_index(F.regexp_replace("value", rf"^[{SPACE}]+", ""), "\n", 1)
    parts = F.split(F.regexp_replace(first, LINE, "$1\n$2\n$3\n$4"), "\n", 5)
    return (
        evaluated_once(lines, "p", parts)
        .where(F.size("p") >= 4)
        .select(
            *order,
            F.col("p")[0].alias("ts_raw"),
            F.col("p")[1].alias("level"),
            F.col("p")[2].alias("service"),
            F.col("p")[3].alias("message"),
        )
        .withColumn("ts", timestamp_from(F.col("ts_raw")))
        .withColumn("ts_invalid", F.col("ts").isNull())
    )


def parse_lines(lines: DataFrame, infer_session: bool = True) -> DataFrame:
    """Raw lines to flat structured records."""
    return with_message_fields(split_lines(lines), infer_session)


def reparse(records: DataFrame) -> DataFrame:
    """Read the message fields again from the text, keeping the stored session id."""
    return with_message_fields(records)
