import random

import pytest
from pyspark.sql import functions as F

from sessionlogs import calltree, chains, parse, sessions, skew
from sessionlogs.analysis import Analysis

SCHEMA = "source_idx int, file_idx int, source_file string, block_start bigint, line_no bigint, value string"


def analysis_of(spark, lines):
    rows = [(0, 0, "f.log", 0, i, v) for i, v in enumerate(lines)]
    records = parse.parse_lines(spark.createDataFrame(rows, SCHEMA).repartition(5))
    return Analysis(records.withColumn("source_bucket", F.lit("index")))


def line(second, level, message, service="svc"):
    return f"[2024-03-20 10:{second // 60:02d}:{second % 60:02d}] [{level}] {service}: {message}"


def random_lines(rng, n_sessions, several_parents):
    """Few ids per session, so that ties, cycles, late parents and duplicates all occur."""
    lines = []
    for s in range(n_sessions):
        ids = [f"urc-a-b-s{s}-{i}" for i in range(rng.randint(3, 9))]
        parent = {u: rng.choice(ids) for u in ids}
        if rng.random() < 0.9:
            lines.append((rng.randint(0, 3), "INFO", f"User logged in session_id=s{s} URC={ids[0]}"))
        if rng.random() < 0.2:
            lines.append((rng.randint(0, 30), "INFO", f"User logged in session_id=s{s} URC={ids[1]}"))
        for _ in range(rng.randint(5, 40)):
            urc = rng.choice(ids)
            uid = rng.choice(ids) if several_parents else parent[urc]
            level = rng.choice(["INFO", "INFO", "WARN", "ERROR", "error"])
            what = rng.choice(["Gateway timeout", "status_code=422", "all nodes down", "validation failed", "fine"])
            message = rng.choice([
                f"Request received, URC={urc}, UID={uid}",
                f"Request received, URC={urc}, UID={uid}",
                f"Request received, URC={urc}, UID={uid}",
                f"Response sent, URC={urc}, UID={uid}, {what}",
                f"Downstream {what}, URC={urc}, UID={uid}",
                f"Downstream {what}, UID={uid}",
                f"Response sent, URC={urc}, {what}",
            ])
            lines.append((rng.randint(0, 30), level, message))
    rng.shuffle(lines)
    return [line(*x) for x in lines]


def in_order(spark, a):
    """The analysed records of each session, in order."""
    out = {}
    for r in a.positions.orderBy("seq").collect():
        out.setdefault(r.session_id, []).append(r)
    return out


def tree_faults(records, tree):
    """What is wrong with a finished tree {urc: (parent, level)}, by the definition of one.

    The root is the first login with an id, there from the start. A request qualifies if its parent is a node attached before
    it and above level 4. Every other node has the parent of the first request for its id that qualifies; ids without such a request are no nodes.
    """
    roots = [r.urc for r in records if r.is_login and r.urc]
    if not roots:
        return ["nodes without a root"] if tree else []
    if tree.get(roots[0]) != (None, 0):
        return ["the root"]
    requests = [(i, r.urc, r.uid) for i, r in enumerate(records) if r.is_request and r.urc]
    attached = {roots[0]: -1}
    for urc in sorted(tree, key=lambda u: tree[u][1]):
        if urc != roots[0]:
            claimed = [i for i, u, p in requests if u == urc and p == tree[urc][0] and i > attached.get(p, len(records))]
            attached[urc] = min(claimed, default=len(records))
    faults = []
    for urc in {u for _, u, _ in requests} | set(tree):
        first = next(((i, p) for i, u, p in requests if u == urc and p in tree and attached[p] < i and tree[p][1] < 4), None)
        if urc != roots[0] and tree.get(urc) != (first and (first[1], tree[first[1]][1] + 1)):
            faults.append((urc, tree.get(urc), first))
    return faults


@pytest.mark.parametrize("seed,several_parents", [(1, False), (2, True), (3, True)])
def test_trees_fit_their_definition(spark, seed, several_parents):
    a = analysis_of(spark, random_lines(random.Random(seed), 120, several_parents))
    trees = {}
    for r in a.nodes.collect():
        trees.setdefault(r.session_id, {})[r.urc] = (r.parent_urc, r.level)
    sessions_ = in_order(spark, a)
    assert len(trees) > 80 and max(level for t in trees.values() for _, level in t.values()) >= 3
    for s, records in sessions_.items():
        assert tree_faults(records, trees.get(s, {})) == []
    for r in a.correlations().collect():
        calls = {c.urc: c for c in r.api_calls}
        assert {u: c.level for u, c in calls.items()} == {u: level for u, (_, level) in trees[r.session_id].items()}
        assert all(sorted(c.children) == sorted(v for v, (p, _) in trees[r.session_id].items() if p == u) for u, c in calls.items())
        assert r.metrics.total_calls == len(calls)


def test_chains_of_small_sessions(spark):
    """Worked out by hand: errors by node in order of attachment, the last response's error after the node's own."""
    u = [f"urc-a-b-s-{i}" for i in range(4)]
    lines = [
        line(0, "INFO", f"User logged in session_id=s URC={u[0]}"),
        line(1, "INFO", f"Request received, URC={u[1]}, UID={u[0]}"),
        line(2, "INFO", f"Request received, URC={u[2]}, UID={u[1]}"),
        line(3, "ERROR", f"second node bad, URC={u[2]}"),
        line(4, "WARN", f"first node status_code=422, URC={u[1]}"),
        line(5, "INFO", f"first node failed quietly, URC={u[1]}"),
        line(6, "ERROR", f"unknown call broken, URC={u[3]}"),
        line(7, "ERROR", f"Response sent, URC={u[2]}, UID={u[1]}, an early answer"),
        line(8, "WARN", f"Response sent, URC={u[2]}, UID={u[1]}, upstream service unavailable"),
        line(9, "ERROR", f"root hurt, UID={u[0]}"),
    ]
    (r,) = analysis_of(spark, lines).correlations().collect()
    (found,) = r.error_chains
    assert [e.message.split(",")[0].split(" URC")[0] for e in found.errors] == ["root hurt", "first node status_code=422", "Response sent", "second node bad"]
    assert found.errors[2].message.endswith("upstream service unavailable")
    assert (found.impact_level, found.total_errors, sum(found.severity_breakdown)) == ("CRITICAL", 4, 4)


@pytest.mark.parametrize("message,impact", [("fine", "LOW"), ("status_code=422", "MEDIUM"), ("gateway timeout", "HIGH"), ("upstream service unavailable", "CRITICAL")])
def test_impacts(spark, message, impact):
    lines = [line(0, "INFO", "User logged in session_id=s URC=urc-a-b-s-0"), line(1, "WARN", f"{message}, URC=urc-a-b-s-0"), line(2, "WARN", "fine too, URC=urc-a-b-s-0")]
    (r,) = analysis_of(spark, lines).correlations().collect()
    assert r.error_chains[0].impact_level == impact


def test_long_dependency_chain_settles(spark):
    """x(i) is attached early and too deep unless x(i-1) was; each decision waits for the one before."""
    lines = [line(0, "INFO", "User logged in session_id=s URC=urc-a-b-s-0")]
    lines += [line(1, "INFO", f"Request received, URC=urc-a-b-s-{i}, UID=urc-a-b-s-{i - 1}") for i in (1, 2, 3)]
    for i in range(10, 30):
        # first choice: below the previous one (fails if that is at level 4), second: below level 3
        lines.append(line(i, "INFO", f"Request received, URC=urc-a-b-s-{i}, UID=urc-a-b-s-{i - 1}"))
        lines.append(line(i, "INFO", f"Request received, URC=urc-a-b-s-{i}, UID=urc-a-b-s-{3 if i % 2 else 2}"))
    a = analysis_of(spark, lines)
    tree = {r.urc: (r.parent_urc, r.level) for r in a.nodes.collect()}
    assert len(tree) == 24 and tree_faults(in_order(spark, a)["s"], tree) == []


def test_hot_parents_are_salted_without_changing_results(spark):
    lines = random_lines(random.Random(7), 30, True)
    a = analysis_of(spark, lines)
    nodes = calltree.call_tree(a.positions, hot_rows=3)
    assert sorted(map(tuple, nodes.collect()), key=str) == sorted(map(tuple, a.nodes.collect()), key=str)
    plain = chains.error_pool(a.positions, a.nodes).drop("chain_seq")
    salted = chains.error_pool(a.positions, a.nodes, hot_rows=3).drop("chain_seq")
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    plain, salted = (calltree.call_pieces(a.nodes, 0, hot_rows=n).collect() for n in (10**6, 3))
    assert sorted(map(tuple, salted), key=str) == sorted(map(tuple, plain), key=str)


def test_hot_keys_counts_and_fans_out(spark):
    df = spark.range(100).select((F.col("id") % 7 == 0).cast("int").alias("k"))
    hot = skew.hot_keys(df, ["k"], 100, floor=20)
    assert [(r.k, r._fan) for r in hot.collect()] == [(0, 5)]
    assert skew.hot_keys(df, ["k"], 100, floor=90) is None


def test_orphans_are_requests_without_a_node(spark):
    a = analysis_of(spark, [
        line(0, "INFO", "User logged in session_id=s URC=urc-a-b-s-0"),
        line(1, "INFO", "Request received, URC=urc-a-b-s-2, UID=urc-a-b-s-1"),
        line(2, "INFO", "Request received, URC=urc-a-b-s-1, UID=urc-a-b-s-0"),
    ])
    assert [(r.urc, r.n_requests) for r in calltree.orphans(a.positions, a.nodes).collect()] == [("urc-a-b-s-2", 1)]


def test_root_by_input_order(spark):
    rows = [(0, i, f"f{i}", 0, 0, line(5 - i, "INFO", f"User logged in session_id=s URC=urc-a-b-s-{i}")) for i in (0, 1)]
    records = parse.parse_lines(spark.createDataFrame(rows, SCHEMA)).withColumn("source_bucket", F.lit("x"))
    pos = sessions.positions(records)
    assert calltree.session_roots(pos).first().root_urc == "urc-a-b-s-1"
    assert calltree.session_roots(pos, by_input_order=True).first().root_urc == "urc-a-b-s-0"


def test_segments_continue_long_groups(spark):
    df = spark.range(0, 50, 1, 8).select(
        F.when(F.col("id") < 37, "big").otherwise("small").alias("k"), F.col("id").alias("v")
    )
    ordered = skew.sequence(df.repartition(8), ["k", "v"], "seg")
    got = {(r.k, r.segment_no): r.vs for r in skew.segments(ordered, ["k"], "seq", F.col("v"), "vs", 10).collect()}
    assert got == {("big", i): list(range(i * 10, min(i * 10 + 10, 37))) for i in range(4)} | {
        ("small", 0): list(range(37, 47)), ("small", 1): [47, 48, 49]
    }


def test_ranks_run_across_ranges(spark):
    # ids of several sorted ranges, as a large table has them
    rows = [("a", (r << 33) + i) for r in range(4) for i in range(5)] + [("b", (2 << 33) + 9)]
    df = spark.createDataFrame(rows, "k string, seq bigint")
    got = [(r.k, r.n) for r in skew.ranked(df, ["k"], "seq", "n").orderBy("k", "seq").collect()]
    assert got == [("a", i) for i in range(1, 21)] + [("b", 1)]


def test_lists_are_whole_or_null(spark):
    df = spark.range(0, 50, 1, 8).select(F.when(F.col("id") < 37, "big").otherwise("small").alias("k"), F.col("id").alias("v"))
    for size, big in ((50, list(range(37))), (20, None)):
        got = {r.k: (r.n_items, r.vs) for r in skew.lists(df.repartition(8), ["k"], "v", F.col("v"), "vs", size).collect()}
        assert got == {"big": (37, big), "small": (13, list(range(37, 50)))}
