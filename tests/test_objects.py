"""Whole JSON objects, whatever the sizes of their lists, parts and tasks."""

import json
from glob import glob

import pytest
from pyspark.sql import functions as F

from sessionlogs import chains, objects, sinks
from tests.test_calltree import analysis_of, line


def lines_of(path):
    found = [x for f in sorted(glob(f"{path}/**/part-*", recursive=True)) for x in open(f, encoding="utf-8").read().split("\n")]
    return [json.loads(x) for x in found if x.strip()]


@pytest.fixture(scope="module")
def large(spark):
    """A session with 2500 calls and errors below one root, one with quotes and line feeds, one without errors."""
    n = 2500
    lines = [line(0, "INFO", "User logged in session_id=s URC=urc-a-b-s-0")]
    lines += [line(1, "INFO", f"Request received, URC=urc-a-b-s-{i}, UID=urc-a-b-s-{0 if i < 2000 else i - 1000}") for i in range(1, n)]
    lines += [line(2, "ERROR", f"bad thing {i}, URC=urc-a-b-s-{i}") for i in range(1, n)]
    lines += [line(0, "INFO", "User logged in session_id=t URC=urc-a-b-t-0"), line(1, "WARN", 'a "quoted\\ text", URC=urc-a-b-t-0')]
    lines += [line(0, "INFO", "User logged in session_id=u URC=urc-a-b-u-0")]
    return analysis_of(spark, lines)


def test_a_large_session_is_one_object(spark, large, tmp_path):
    sinks.write_full_analysis(large.nodes, large.pool, str(tmp_path / "full"))
    written = {x["session_id"]: x for x in lines_of(tmp_path / "full")}
    rows = {r.session_id: r.asDict(recursive=True) for r in large.correlations().collect()}
    assert written == rows and set(rows) == {"s", "t", "u"}
    s = written["s"]
    assert len(s["api_calls"]) == s["metrics"]["total_calls"] == 2500 and len(s["error_chains"][0]["errors"]) == 2499
    assert s["api_calls"][0]["children"] == [f"urc-a-b-s-{i}" for i in range(1, 2000)]
    assert sum(len(c["children"]) for c in s["api_calls"]) == 2499
    assert written["u"]["error_chains"] == []
    read = spark.read.schema(large.correlations().schema).json(str(tmp_path / "full"))
    assert {r.session_id: r.asDict(recursive=True) for r in read.collect()} == rows


@pytest.mark.parametrize("most", [700, 2499, 9])
def test_parts_hold_the_same_content(large, tmp_path, most):
    nodes = large.nodes.where("session_id <> 's' or length(urc) < 12")  # few enough for small parts
    pool = large.pool.where("session_id <> 's' or length(urc) < 12")
    if most > 9:
        nodes, pool = large.nodes, large.pool
    sinks.write_full_analysis(nodes, pool, str(tmp_path / "parts"), most=most)
    want = {r.session_id: r.asDict(recursive=True) for r in chains.correlation_records(nodes, pool).collect()}
    for key, whole in want.items():
        parts = sorted((x for x in lines_of(tmp_path / "parts") if x["session_id"] == key), key=lambda x: x.get("part", 0))
        assert [x.get("part", 0) for x in parts] == list(range(len(parts))) and (len(parts) > 1) == (key == "s")
        joined: dict = {}
        for call in (c for x in parts for c in x["api_calls"]):  # a call that goes on in the next part is repeated there
            joined.setdefault(call["urc"], []).extend(call["children"])
        assert joined == {c["urc"]: c["children"] for c in whole["api_calls"]} and list(joined) == [c["urc"] for c in whole["api_calls"]]
        assert [e for x in parts for c in x["error_chains"] for e in c["errors"]] == [e for c in whole["error_chains"] for e in c["errors"]]


def test_lists_beyond_a_row_are_null_there_only(large, tmp_path):
    rows = {r.session_id: r for r in chains.correlation_records(large.nodes, large.pool, size=100).collect()}
    assert rows["s"].api_calls is None and rows["s"].error_chains[0].errors is None
    assert rows["s"].metrics.total_calls == 2500 and rows["s"].error_chains[0].total_errors == 2499
    assert len(rows["t"].api_calls) == 1 and rows["u"].error_chains == []


def test_root_causes(spark, large, tmp_path):
    sinks.write_root_causes(large.nodes, large.pool, str(tmp_path / "causes"), folder_per_session=True)
    assert sorted(glob(f"{tmp_path}/causes/session_id=*")) == [f"{tmp_path}/causes/session_id={k}" for k in "st"]
    written = {x["session_id"]: x["root_causes"] for x in lines_of(tmp_path / "causes")}
    rows = {r.session_id: r.asDict(recursive=True) for r in large.root_causes().collect()}
    assert written == {k: [v] for k, v in rows.items()} and set(rows) == {"s", "t"}
    assert len(written["s"][0]["full_error_chain_details_for_context"]["errors"]) == 2499


def test_no_objects(spark, tmp_path):
    marks = spark.createDataFrame([], "id string, marks array<string>")
    rows = spark.createDataFrame([("a", 1)], "id string, n bigint").limit(0)
    objects.write_objects(marks, objects.pieces(rows, "id", 0, "n", F.lit("x")), "id", str(tmp_path / "none"))
    assert lines_of(tmp_path / "none") == []
