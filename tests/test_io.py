import os
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sessionlogs import analyse, parse, sessions, sinks, sources

GATEWAY = [
    "[2024-03-20 10:15:01] [INFO] api_gateway: User 'x' logged in session_id=s1 URC=urc-root-s1",
    "[2024-03-20 10:15:01] [INFO] api_gateway: Request received for /a, URC=urc-pay-req-s1-1, UID=urc-root-s1",
    "",
    "[2024-03-20 10:15:01] [INFO] api_gateway: Request received for /a, URC=urc-pay-req-s1-1, UID=urc-root-s1",
    "[bad time] [INFO] api_gateway: no session here",
]
PAYMENT = [
    "[2024-03-20 10:15:02] [ERROR] payment_service: Response sent, URC=urc-pay-req-s1-1, UID=urc-root-s1, status_code=504, "
    "error_details=Gateway timeout - upstream service unavailable",
    "[2024-03-20 10:18:30] [WARN] payment_service: status_code=400, URC=urc-pay-req-s1-1",
]


@pytest.fixture()
def log_files(tmp_path):
    paths = []
    for name, lines in (("gateway.v1.log", GATEWAY), ("payment.log", PAYMENT)):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n")
        paths.append(str(path))
    return paths


def test_scan_keeps_order_and_skips_missing_files(spark, log_files):
    lines = sources.scan_log_text(spark, [log_files[0], log_files[0] + ".missing", log_files[1]])
    rows = lines.orderBy(*sources.LINE_ORDER).collect()
    assert [r.value for r in rows] == GATEWAY + PAYMENT
    assert [r.file_idx for r in rows] == [0] * 5 + [2] * 2
    assert sources.scan_log_text(spark, [log_files[0] + ".missing"]).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.scan_log_text(spark, [log_files[0] + ".missing"], skip_missing=False)


def test_line_order_holds_across_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = sources.scan_log_text(spark, [str(path)])
        assert lines.rdd.getNumPartitions() > 3
        assert lines.select("block_start").distinct().count() > 3
        got = [r.value for r in lines.orderBy(*sources.LINE_ORDER).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"line {i}" for i in range(5000)]


def test_bucket_is_the_file_name_up_to_its_first_dot(spark, log_files):
    records = sources.with_file_bucket(parse.parse_lines(sources.scan_log_text(spark, log_files)))
    assert {r[0] for r in records.select("source_bucket").collect()} == {"gateway", "payment"}


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_index_round_trip_and_reload(spark, log_files, tmp_path, fmt):
    records = parse.parse_lines(sources.scan_log_text(spark, log_files))
    path = str(tmp_path / "index")
    sinks.write_index(records, path, fmt)
    sinks.write_index(records, path, fmt)  # a reload duplicates, deduplication removes it
    docs = sources.scan_indexed_docs(spark, path, fmt=fmt)
    assert docs.count() == 12
    a = analyse(spark, index=path, fmt=fmt)
    assert a.positions.count() == 4
    cause = a.root_causes().collect()
    assert [(c.session_id, c.root_urc_of_session, c.overall_chain_impact) for c in cause] == [("s1", "urc-root-s1", "CRITICAL")]
    chain = cause[0].full_error_chain_details_for_context
    assert [(e.level, e.calculated_severity) for e in chain.errors] == [("ERROR", "CRITICAL"), ("WARN", "MEDIUM")]
    assert chain.errors[0].timestamp == "2024-03-20T10:15:02Z"
    if fmt == "parquet":
        scan = sources.scan_indexed_docs(spark, path, datetime(2024, 3, 20), datetime(2024, 3, 21))
        assert "event_date" in scan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]


def scans_of(df):
    """Of each file scan of the plan, its pushed filters and its read schema."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    conf.unset("spark.sql.maxMetadataStringLength")
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>\s", plan + "\n")


@pytest.fixture
def many_files(spark):
    """Small tables keep the partitions that large ones have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_index_is_read_by_time_and_field(spark, tmp_path, many_files):
    """A day of 4000 records: bounds reach the scan, narrow ranges leave most row groups out, stored fields need no message."""
    lines = [(0, 0, "f", 0, i, f"[2024-03-20 {i // 200:02d}:{i // 4 % 50:02d}:0{i % 4}] [INFO] s: text {i}, URC=urc-a-b-s-{i}") for i in range(4000)]
    schema = "source_idx int, file_idx int, source_file string, block_start bigint, line_no bigint, value string"
    path = str(tmp_path / "index")
    sinks.write_index(parse.parse_lines(spark.createDataFrame(lines, schema).repartition(7, "line_no")), path)
    start, end = datetime(2024, 3, 20, 7, 10), datetime(2024, 3, 20, 7, 19, 59)
    found = sources.scan_indexed_docs(spark, path, start, end)
    assert found.count() == 40 == found.where("ts_raw is null and not ts_invalid").count()
    stored, plain = scans_of(found.select("urc"))
    for pushed, _ in (stored, plain):
        assert "GreaterThanOrEqual(ts,2024-03-20" in pushed and "LessThanOrEqual(ts,2024-03-20" in pushed
    assert "IsNotNull(is_login)" in stored[0] and "IsNull(is_login)" in plain[0]
    assert "urc" in stored[1] and "message" not in stored[1]
    times = [(r[0], r[1]) for r in spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.min("ts"), F.max("ts")).select("min(ts)", "max(ts)").collect()]
    assert len(times) > 1 and all(a[1] <= b[0] for a, b in zip(sorted(times), sorted(times)[1:]))


def test_one_crowded_second_is_split_over_files(spark, tmp_path, many_files):
    lines = [(0, 0, "f", 0, i, f"[2024-03-20 10:00:00] [INFO] s: text {i}") for i in range(4000)]
    schema = "source_idx int, file_idx int, source_file string, block_start bigint, line_no bigint, value string"
    path = str(tmp_path / "index")
    sinks.write_index(parse.parse_lines(spark.createDataFrame(lines, schema)), path)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 1 and max(sizes) < 2000


def test_stored_and_parsed_documents_side_by_side(spark, log_files, tmp_path):
    records = parse.parse_lines(sources.scan_log_text(spark, log_files))
    path = str(tmp_path / "index")
    sinks.write_index(records, path, "json")
    plain = spark.read.json(path).select("`@timestamp`", "`log.level`", "`service.name`", "message")
    plain.write.mode("append").json(f"{path}/event_date=2024-03-20")
    names = ["session_id", "urc", "uid", "error_type", "severity", "is_login", "is_request", "is_response", "metrics", "message", "ts"]
    for reparse in (False, True):
        rows = sources.scan_indexed_docs(spark, path, fmt="json", reparse=reparse).select(*names).collect()
        assert len(rows) == 12 and all(n % 2 == 0 for n in Counter(map(str, rows)).values())


def test_plain_documents_are_parsed_when_read(spark, tmp_path):
    path = tmp_path / "plain"
    path.mkdir()
    (path / "d.json").write_text(
        '{"@timestamp": "2024-03-20T10:15:01Z", "log.level": "INFO", "service.name": "g", '
        '"message": "User logged in session_id=s1 URC=urc-root-s1"}\n{"message": null}\n'
    )
    rows = sources.scan_indexed_docs(spark, str(path), fmt="json").collect()
    assert [(r.session_id, r.urc, r.is_login) for r in rows] == [("s1", "urc-root-s1", True), (None, None, False)]
    at = datetime(2024, 3, 20, 10, 15, 1)
    assert sources.scan_indexed_docs(spark, str(path), at, fmt="json").count() == 1


def test_files_and_index_give_the_same_analysis(spark, log_files, tmp_path):
    path = str(tmp_path / "index")
    sinks.write_index(parse.parse_lines(sources.scan_log_text(spark, log_files)), path)
    by_index = analyse(spark, index=path).correlations().collect()
    by_files = analyse(spark, log_files=log_files).correlations().collect()
    assert by_index == by_files and len(by_files) == 1
    with pytest.raises(ValueError):
        analyse(spark, log_files=log_files, index=path)
    with pytest.raises(ValueError):
        analyse(spark)


def test_bad_times_and_input_order_survive(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("\n".join([
        "[2024-03-20 10:15:03] [INFO] s: logged in session_id=s1 URC=urc-root-s1",
        "[2024-03-20 10:15:09] [INFO] s: later session_id=s1",
        "[bad one] [INFO] s: same session_id=s1",
        "[2024-03-20 10:15:05] [INFO] s: earlier session_id=s1",
        "[bad two] [INFO] s: same session_id=s1",
    ]))
    files = analyse(spark, log_files=[str(path)])
    sinks.write_index(parse.parse_lines(sources.scan_log_text(spark, [str(path)])), str(tmp_path / "index"))
    index = analyse(spark, index=str(tmp_path / "index"))
    assert files.positions.count() == index.positions.count() == 5
    words = [[m.split()[0] for m in a.log_content().first().content.split("\n")] for a in (files, index)]
    assert words == [["logged", "later", "same", "earlier", "same"], ["same", "same", "logged", "earlier", "later"]]


def test_same_names_in_two_folders_keep_their_order(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "app.log").write_text("".join(f"{d}{i}\n" for i in range(3)))
    rows = sources.scan_log_text(spark, [str(tmp_path / "*" / "app.log")]).orderBy(*sources.LINE_ORDER).collect()
    assert [r.value for r in rows] == ["a0", "a1", "a2", "b0", "b1", "b2"]


def test_time_range(spark, log_files):
    records = parse.parse_lines(sources.scan_log_text(spark, log_files))
    start = datetime(2024, 3, 20, 10, 15, 1)
    assert sources.time_range(records, start).count() == 4  # two minutes
    assert sources.time_range(records, start, start).count() == 3
    assert sources.time_range(records).count() == 6
    with pytest.raises(ValueError):
        sources.time_range(records, end=start)
    assert [r.line_no for r in sources.earliest(records, 1).collect()] == [4]  # no time sorts first


def test_merge_keeps_both_sources(spark, log_files):
    records = parse.parse_lines(sources.scan_log_text(spark, log_files))
    merged = sessions.merge_sources(
        records.withColumn("source_bucket", F.lit("index")), sources.with_file_bucket(records)
    )
    got = {(r.source_bucket, r.n_records) for r in sessions.session_counts(merged).collect()}
    assert got == {("index", 5), ("gateway", 3), ("payment", 2)}
    content = {r.source_bucket: r.content for r in sessions.log_content(sessions.positions(merged)).collect()}
    assert content["payment"].split("\n") == [m.split("payment_service: ", 1)[1] for m in PAYMENT]


def test_dedup_keeps_the_first_copy(spark):
    lines = ["[2024-03-20 10:15:01] [WARN] a: session_id=s m", "[2024-03-20 10:15:01] [INFO] a: session_id=s m"]
    lines += ["[bad 1] [INFO] a: session_id=s m", "[bad 2] [INFO] a: session_id=s m", "[bad 2] [INFO] a: session_id=s m"]
    rows = [(0, 0, "f", 0, i, v) for i, v in enumerate(lines)]
    schema = "source_idx int, file_idx int, source_file string, block_start bigint, line_no bigint, value string"
    records = parse.parse_lines(spark.createDataFrame(rows, schema)).withColumn("source_bucket", F.lit("x"))
    pos = sessions.positions(records)
    assert [(r.line_no, r.level, r.copies) for r in pos.orderBy("seq").collect()] == [
        (2, "INFO", 1), (3, "INFO", 2), (0, "WARN", 2)
    ]
    assert [tuple(r) for r in sessions.dedup_counts(pos).collect()] == [("s", 5, 3)]


def test_result_files(spark, log_files, tmp_path):
    a = analyse(spark, log_files=log_files)
    sinks.write_full_analysis(a.nodes, a.pool, str(tmp_path / "full"), folder_per_session=True)
    sinks.write_root_causes(a.nodes, a.pool, str(tmp_path / "causes"))
    full = spark.read.json(str(tmp_path / "full")).collect()
    assert [(r.session_id, r.root_urc, r.metrics.total_calls) for r in full] == [("s1", "urc-root-s1", 2)]
    assert os.path.isdir(tmp_path / "full" / "session_id=s1")
    causes = spark.read.json(str(tmp_path / "causes")).collect()
    assert [len(r.root_causes) for r in causes] == [1]
    sinks.write_root_causes(a.nodes, a.pool.where("1 = 0"), str(tmp_path / "none"))
    assert not [f for f in os.listdir(tmp_path / "none") if f.startswith("part-") and os.path.getsize(tmp_path / "none" / f)]


def test_whole_analysis_is_written(spark, log_files, tmp_path):
    analyse(spark, log_files=log_files).write(str(tmp_path / "out"))
    read = {name: spark.read.json(str(tmp_path / "out" / name)) for name in os.listdir(tmp_path / "out")}
    assert {name: df.count() for name, df in read.items()} == {
        "correlations": 1, "log_content": 2, "raw_logs": 4, "root_causes": 1
    }
    # absent values are kept as nulls
    assert "cif_id" in read["raw_logs"].columns
    cause = read["root_causes"].select(F.inline("root_causes")).first()
    assert cause.error_specific_api_endpoint is None and cause.error_specific_urc == "urc-pay-req-s1-1"


def test_routed_lines(spark, log_files, tmp_path):
    lines = sources.scan_log_text(spark, log_files)
    sinks.write_routed_lines(lines, str(tmp_path / "routes"))
    got = {r.route: r.n for r in spark.read.text(str(tmp_path / "routes")).groupBy("route").agg(F.count("*").alias("n")).collect()}
    assert got == {"gateway": 4, "payment": 2, "tibco": 1}


def test_text_documents_of_one_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("no")
    assert [tuple(r) for r in sources.scan_documents(spark, str(tmp_path)).collect()] == [("a.txt", "one\ntwo")]
