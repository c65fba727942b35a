import json

import pytest
from pyspark.sql import functions as F

from sessionlogs import chains, modeljson, retrieval, rootcause
from tests.test_calltree import analysis_of, line

GOOD = {
    "problem_description": "p",
    "probable_root_cause_summary": "q",
    "key_error_log_messages": ["m"],
    "confidence_score": 0.5,
    "associated_identifiers": {"session_id": "s", "urc": None},
}


@pytest.mark.parametrize(
    "text,want",
    [
        ("```json\n{}\n```", "{}"), ("```\n{}\n```", "{}"), ("{}", "{}"), ("```", ""), ("``````", ""), ("```json\n{}", "```json\n{}"),
        ("```\njson\n1\n```", "1"), ("```x\na\nb\n```", "a\nb"), ("a\n```", "a\n```"), ("", ""), ("```\n```", ""),
    ],
)
def test_code_fence(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(modeljson.strip_code_fence(F.col("t"))).first()[0] == want


def test_analyses_are_checked(spark):
    cases = {
        "ok": GOOD,
        "one string": {**GOOD, "key_error_log_messages": "m"},
        "no score": {k: v for k, v in GOOD.items() if k != "confidence_score"},
        "null score": {**GOOD, "confidence_score": None},
        "empty list": {**GOOD, "key_error_log_messages": []},
        "numbers": {**GOOD, "key_error_log_messages": [1]},
        "mixed": {**GOOD, "key_error_log_messages": ["m", 1]},
        "no messages": {k: v for k, v in GOOD.items() if k != "key_error_log_messages"},
        "no ids": {k: v for k, v in GOOD.items() if k != "associated_identifiers"},
        "no problem": {**GOOD, "problem_description": None},
        "text score": {**GOOD, "confidence_score": "high"},
    }
    rows = [(name, json.dumps(v)) for name, v in cases.items()] + [("cut", json.dumps(GOOD)[:30]), ("none", None)]
    replies = spark.createDataFrame(rows, "id string, reply string")
    got = {r.id: r for r in modeljson.analyses(replies).collect()}
    assert {i for i, r in got.items() if r.is_valid} == {"ok", "one string", "no score", "null score"}
    assert {i: r.reason for i, r in got.items() if not r.is_valid} == {
        "empty list": "key_error_log_messages", "numbers": "key_error_log_messages", "mixed": "key_error_log_messages",
        "no messages": "key_error_log_messages", "no ids": "associated_identifiers",
        "no problem": "problem_description", "text score": "confidence_score",
    }
    assert got["one string"].llm_initial_analysis.key_error_log_messages == ["m"]
    assert got["ok"].llm_initial_analysis.associated_identifiers.session_id == "s"
    assert {r.id for r in modeljson.rejected(replies).collect()} == {"cut", "none"}


@pytest.mark.parametrize(
    "body,ok",
    [
        ('{"a": 1}', True), (' {"a": [1, 2]} ', True), ("[1]", True), ("null", True), ('"x"', True),
        ('{"a": 1} xyz', False), ('{"a": 1}\n```', False), ('{"a": 1}, {"b": 2}', False), ('1, "b": 2', False), ("1], [2", False), ("1}", False),
        ("", False), ("{", False), ('{"a": NaN}', False), ('{"a": 1, "a": 2}', False),
    ],
)
def test_only_whole_bodies_parse(spark, body, ok):
    df = spark.createDataFrame([(body,)], "reply string")
    assert modeljson.parsed_replies(df).first().parsed_ok is ok


def test_recommendations(spark):
    item = {"recommendation_type": "t", "recommendation_description": "d"}
    cases = {
        "ok": ([{**item, "action_steps": ["a"]}], None), "no items": ([], None),
        "absent": ([{**item, "action_steps": None, "relevant_documentation": [], "applicable_to_identifiers": {"urc": None, "session_id": "s"}}], None),
        "no type": ([item, {"recommendation_description": "d"}], "recommendations[1].recommendation_type"),
        "null text": ([{**item, "recommendation_description": None}], "recommendations[0].recommendation_description"),
        "mixed steps": ([{**item, "action_steps": ["a", 2]}], "recommendations[0].action_steps"),
        "lone step": ([{**item, "action_steps": "a"}], "recommendations[0].action_steps"),
        "numbers": ([{**item, "relevant_documentation": [1]}], "recommendations[0].relevant_documentation"),
        "id list": ([{**item, "applicable_to_identifiers": ["s"]}], "recommendations[0].applicable_to_identifiers"),
        "id number": ([{**item, "applicable_to_identifiers": {"urc": 1}}], "recommendations[0].applicable_to_identifiers"),
        "text item": (["x", None, item], "recommendations[0].item"), "no list": ("x", "recommendations"), "null": (None, "recommendations"),
    }
    rows = [(name, json.dumps({"recommendations": v})) for name, (v, _) in cases.items()] + [("cut", "{"), ("none", None), ("other", "{}")]
    got = {r.id: r for r in modeljson.recommendations(spark.createDataFrame(rows, "id string, reply string")).collect()}
    want = {name: reason for name, (_, reason) in cases.items()} | {"cut": "json", "none": "json", "other": "recommendations"}
    assert {i: r.reason for i, r in got.items()} == want
    assert all(r.is_valid == (r.reason is None) == (r.llm_recommendations is not None) for r in got.values())
    assert got["ok"].llm_recommendations.recommendations[0].action_steps == ["a"] and got["text item"].item_reasons == ["item", "item", None]


def test_rejects_are_written(spark, small, tmp_path):
    advice = json.dumps({"recommendations": [{"recommendation_type": 1}]})
    rows = [("s", json.dumps(GOOD), advice), ("t", "{", None), ("u", json.dumps({**GOOD, "key_error_log_messages": []}), "x")]
    small.write(str(tmp_path), replies=spark.createDataFrame(rows, "session_id string, analysis string, recommendations string"))
    rejects = spark.read.json(f"{tmp_path}/rejects")
    assert {(r.session_id, r.part, r.reason) for r in rejects.collect()} == {
        ("s", "recommendations", "recommendations[0].recommendation_type"), ("t", "analysis", "json"),
        ("u", "analysis", "key_error_log_messages"), ("u", "recommendations", "json"),
    }
    cause = spark.read.json(f"{tmp_path}/root_causes").select(F.inline("root_causes")).collect()
    assert [(c.session_id, c.llm_initial_analysis.problem_description, c.llm_recommendations) for c in cause] == [("s", "p", None)]


@pytest.fixture(scope="module")
def small(spark):
    return analysis_of(spark, [
        line(0, "INFO", "User logged in session_id=s URC=urc-a-b-s-0"),
        line(1, "INFO", "Request received, URC=urc-a-b-s-1, UID=urc-a-b-s-0"),
        line(2, "ERROR", "pool exhausted deadlock, UID=urc-a-b-s-1"),
        line(3, "WARN", "late, URC=urc-a-b-s-0"),
        line(4, "INFO", "it failed, URC=urc-a-b-s-1"),
        line(0, "INFO", "User logged in session_id=t URC=urc-a-b-t-0"),
        line(1, "INFO", "it failed, URC=urc-a-b-t-0"),
    ])


def test_root_cause_records(spark, small):
    rows = small.root_causes().collect()
    assert [r.session_id for r in rows] == ["s"]
    r = rows[0]
    # chain order is by node, so the later error on the root comes first
    assert r.triggering_error_message == "late, URC=urc-a-b-s-0"
    assert (r.root_urc_of_session, r.overall_chain_impact, r.error_specific_uid) == ("urc-a-b-s-0", "HIGH", None)
    assert r.full_error_chain_details_for_context.total_errors == 2
    headers = {h.session_id: (h.total_errors, h.impact_level) for h in chains.chain_headers(small.pool).collect()}
    assert headers == {"s": (2, "HIGH"), "t": (0, "LOW")}
    assert [x.session_id for x in chains.sessions_with_errors(small.pool).collect()] == ["s"]


def test_trigger_without_chain(spark, small):
    lost = chains.trigger_errors(small.pool).withColumn("message", F.lit("other")).withColumn("timestamp", F.lit("never"))
    row = rootcause.trigger_context(lost, small.nodes, small.pool).first()
    assert (row.impact_level, row.total_errors) == ("UNKNOWN", None)
    by_time = chains.trigger_errors(small.pool).withColumn("message", F.lit("other"))
    assert rootcause.trigger_context(by_time, small.nodes, small.pool).first().impact_level == "HIGH"
    stranger = lost.withColumn("session_id", F.lit("zz"))
    assert rootcause.trigger_context(stranger, small.nodes, small.pool).first().root_urc == "unknown"


def test_contexts(spark, small):
    text = rootcause.rca_context(small.nodes, small.pool, "see manual").first().context
    for part in ("- Session ID: s", "- UID: N/A", "- Severity: LOW", "see manual", '"impact_level" : "HIGH"'):
        assert part in text
    replies = spark.createDataFrame([("s", json.dumps(GOOD)), ("x", "{")], "session_id string, reply string")
    found = modeljson.analyses(replies).select("session_id", "llm_initial_analysis")
    packs = rootcause.recommendation_context(chains.trigger_errors(small.pool), found).collect()
    assert [p.session_id for p in packs] == ["s"] and '"problem_description" : "p"' in packs[0].context
    output = found.withColumn("llm_recommendations", F.lit(None).cast("struct<recommendations:array<string>>"))
    rows = small.root_causes(output).collect()
    assert [r.llm_initial_analysis.problem_description for r in rows] == ["p"]


def test_analyses_are_not_broadcast(spark, small):
    replies = spark.createDataFrame([("s", json.dumps(GOOD))], "session_id string, reply string")
    found = modeljson.analyses(replies).select("session_id", "llm_initial_analysis")
    packs = rootcause.recommendation_context(chains.trigger_errors(small.pool), found)
    assert [p.session_id for p in packs.collect()] == ["s"]
    plan = packs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_documentation_of_the_fixed_queries(spark, small):
    texts = ["system architecture of the gateway", "error patterns of the system", "remediation steps for queues", "configuration guides", "lunch menu", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "vec_id long, content string")
    text = small.rca_contexts(chunks).first().context
    listed = text.split("Documentation:\n")[1]
    assert "system architecture of the gateway" in listed and "error patterns of the system" in listed
    best = rootcause.rca_context(small.nodes, small.pool, retrieval.fixed_context(chunks, k=2)).first().context.split("Documentation:\n")[1]
    assert set(best.split(" ")) == set((texts[0] + " " + texts[1]).split(" "))
    found = modeljson.analyses(spark.createDataFrame([("s", json.dumps(GOOD))], "session_id string, reply string")).select("session_id", "llm_initial_analysis")
    advice = small.recommendation_contexts(found, chunks).first().context
    assert "remediation steps for queues" in advice and "configuration guides" in advice
    for none in (chunks.limit(0), None):
        assert small.rca_contexts(none).first().context.endswith("Documentation:\n")
