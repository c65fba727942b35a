
import pytest
from pyspark.sql import functions as F

from sessionlogs import evidence, parse


def parsed(spark, lines, **kw):
    rows = [(i, v) for i, v in enumerate(lines)]
    df = parse.parse_lines(spark.createDataFrame(rows, "line_no int, value string"), **kw)
    return {r.line_no: r for r in df.collect()}


def test_lines_split_at_first_separators(spark):
    lines = [
        "[2024-03-20 10:15:01] [INFO] a: b: c",
        "   \t[2024-03-20 10:15:01] [INFO] a: padded \t ",
        "[] [] : m",
        "no brackets",
        "",
        "[2024-03-20 10:15:01] [INFO] a: ",
        "[2024-03-20 10:15:01] [INFO] a: d: ",
        "x [2024-03-20 10:15:01] [INFO] a: b",
        "[2024-03-20 10:15:01] [INFO] a: first second\u0085third",
        "[a] b] [c] d] e: f] [g] h: i",
    ]
    got = {i: (r.ts_raw, r.level, r.service, r.message) for i, r in parsed(spark, lines).items()}
    time = "2024-03-20 10:15:01"
    assert got == {
        0: (time, "INFO", "a", "b: c"),
        1: (time, "INFO", "a", "padded"),
        2: ("", "", "", "m"),
        6: (time, "INFO", "a", "d:"),
        8: (time, "INFO", "a", "first\u2028second\u0085third"),
        9: ("a] b", "c", "d] e", "f] [g] h: i"),
    }


def test_values_of_several_lines_count_by_their_first(spark):
    lines = ["junk\nINFO\nsvc\nmessage", "[t] [INFO] s: one\ntwo\nthree\nfour", "\n [t] [INFO] s: m"]
    assert {i: r.message for i, r in parsed(spark, lines).items()} == {1: "one", 2: "m"}


def test_times_are_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", other)
            rows = [(i, f"[{t}] [INFO] s: m") for i, t in enumerate(["2024-03-20 10:15:01", "2024-3-10 2:30:0"])]  # the second is no local time in New York
            df = parse.parse_lines(spark.createDataFrame(rows, "line_no int, value string"))
            found = df.select("line_no", parse.iso_time(F.col("ts")).alias("t"), parse.utc_clock(F.col("ts")).cast("date").cast("string").alias("d")).collect()
            assert {r.line_no: (r.t, r.d) for r in found} == {0: ("2024-03-20T10:15:01Z", "2024-03-20"), 1: ("2024-03-10T02:30:00Z", "2024-03-10")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "text,iso",
    [
        ("2024-03-20 10:15:01", "2024-03-20T10:15:01Z"),
        ("2024-3-2 1:5:9", "2024-03-02T01:05:09Z"),
        ("2024-03-20  10:15:01", "2024-03-20T10:15:01Z"),
        ("2024-13-20 10:15:01", None),
        ("2024-02-30 10:15:01", None),
        ("2024-03-20T10:15:01", None),
        ("20/03/2024", None),
        ("", None),
    ],
)
def test_timestamps(spark, text, iso):
    row = parsed(spark, [f"[{text}] [INFO] s: m"])[0]
    assert (row.ts and row.ts.strftime("%Y-%m-%dT%H:%M:%SZ")) == iso
    assert row.ts_invalid == (iso is None)


def test_fields(spark):
    messages = [
        "User 'x' logged in session_id=abc cif_id=C1 URC=urc-a-b-zzz-1",
        "Request received for /api, URC=urc-pay-req-gbx131-01, UID=urc-x-y-other9-02, transaction_type=t",
        "Response sent, URC=urc-order-validation-db-gbx131-03, UID=urc-pay-req-gbx131-01, duration: 12 ms",
        "Request received and response sent, endpoint=/api/v1/x,",
        "DURATION: 45", "duration=5", "duration 7", "urc=low UID=,x UID=ok",
        "URC=a b", "severity=CRITICAL all good",
    ]
    rows = parsed(spark, [f"[2024-03-20 10:15:01] [INFO] s: {m}" for m in messages])
    assert (rows[0].is_login, rows[0].session_id, rows[0].cif_id) == (True, "abc", "C1")
    assert (rows[1].is_request, rows[1].session_id, rows[1].transaction_type) == (True, "gbx131", "t")
    assert (rows[2].is_response, rows[2].session_id, rows[2].metrics.duration_ms) == (True, "gbx131", 12)
    assert (rows[3].is_request, rows[3].is_response, rows[3].api_endpoint) == (True, False, "/api/v1/x")
    assert [rows[i].metrics.duration_ms for i in (4, 5, 6)] == [45, None, 7]
    assert (rows[7].urc, rows[7].uid) == (None, "ok")
    assert rows[8].urc == "a"
    df = spark.createDataFrame([(messages[9], "HIGH"), (messages[0], "HIGH")], "m string, s string")
    assert [r[0] for r in df.select(evidence.stated_severity(F.col("m"), F.col("s"))).collect()] == ["CRITICAL", "HIGH"]


def test_session_is_not_inferred_on_request(spark):
    rows = parsed(
        spark,
        ["[t] [INFO] s: URC=urc-a-b-x1-1", "[t] [INFO] s: session_id=q URC=urc-a-b-x1-1"],
        infer_session=False,
    )
    assert (rows[0].session_id, rows[1].session_id) == (None, "q")


@pytest.mark.parametrize(
    "level,message,kind,severity,content",
    [
        ("ERROR", "Timeout reading", "timeout", "HIGH", "HIGH"),
        ("warn", "a Connection was lost", "connection", "MEDIUM", "LOW"),
        ("INFO", "validation failed", "validation", None, "MEDIUM"),
        ("INFO", "validation passed", None, None, "LOW"),
        ("debug", "it failed", "unknown_error", None, "LOW"),
        ("ERROR", "all is lost", "system", "HIGH", "LOW"),
        ("ERROR", "authentication timeout", "timeout", "HIGH", "HIGH"),
        ("ERROR", "internal server error", "system", "HIGH", "MEDIUM"),
        ("ERROR", "database deadlock detected", "system", "HIGH", "HIGH"),
        ("ERROR", "upstream service unavailable", "system", "HIGH", "CRITICAL"),
        ("WARN", "status_code=422", "system", "MEDIUM", "MEDIUM"),
        ("WARN", "Bad Request", "system", "MEDIUM", "MEDIUM"),
    ],
)
def test_error_types_and_severities(spark, level, message, kind, severity, content):
    row = parsed(spark, [f"[t] [{level}] s: {message}"])[0]
    assert (row.error_type, row.severity) == (kind, severity)
    assert spark.createDataFrame([(message,)], "m string").select(parse.content_severity(F.col("m"))).first()[0] == content


def test_fallback_types_and_routes(spark):
    df = spark.createDataFrame(
        [("bad credentials", None), ("queue full", "unknown"), ("high latency", "unknown"), ("x", None), ("queue", "system")],
        "m string, k string",
    )
    got = [r[0] for r in df.select(parse.fallback_error_type(F.col("m"), F.col("k"))).collect()]
    assert got == ["authentication", "queue", "performance", "unknown", "system"]
    lines = spark.createDataFrame([("api_gateway order",), ("my order",), ("payment",), ("else",)], "v string")
    assert [r[0] for r in lines.select(parse.route(F.col("v"))).collect()] == ["gateway", "payment", "payment", "tibco"]


def test_filters_do_not_repeat_the_parsing(spark):
    lines = spark.createDataFrame([(1, "x")], "line_no int, value string")
    plan = parse.parse_lines(lines).where("session_id is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?dU)") == 1
    assert plan.count("(?U)session_id=") == 1
