"""api_calls_nested keeps every call and every child, however long a session's list is."""

from sessionlogs import calltree, chains, queries

FOLDER = "/root/testdata/sf0.001"


def test_no_call_is_lost_beyond_the_list_size(spark, monkeypatch):
    full = {tuple(r) for r in queries.api_calls_nested(spark, FOLDER).collect()}
    nodes = queries.analysis(spark, FOLDER).nodes
    assert len(full) == nodes.count()
    # lists of more than one item are NULL in the nested records; the calls must not depend on them
    monkeypatch.setattr(calltree.calls, "__defaults__", (1,))
    monkeypatch.setattr(calltree.children, "__defaults__", (1,))
    monkeypatch.setattr(chains.correlation_records, "__defaults__", (1,))
    assert {tuple(r) for r in queries.api_calls_nested(spark, FOLDER).collect()} == full
    assert any("," in r[4] for r in full)
