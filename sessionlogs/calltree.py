"""Call trees: requests linked to their parents, and the responses and errors on each node.

A request names its own id (``urc``) and its parent's (``uid``). Read in order, a
request becomes a node if its id is new and its parent already is a node above
the last level. ``attach_seq`` is the position at which a node starts to exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlogs.parse import is_error_level
from sessionlogs.objects import pieces
from sessionlogs.skew import HOT_ROWS, LIST_ITEMS, hot_keys, join_many_to_one, lists
from sessionlogs.sources import LINE_ORDER
from sessionlogs.stage import materialise

# fixed value: deepest level of a call tree, the root being 0
MAX_LEVEL = 4
NODE = ["session_id", "urc", "parent_urc", "level", "attach_seq"]


def session_roots(positions: DataFrame, by_input_order: bool = False) -> DataFrame:
    """The first login that carries a call id, per session.

    "First" is by time; ``by_input_order`` takes file order instead, as for
    sources that are not read in time order.
    """
    logins = positions.where(F.col("is_login") & F.col("urc").isNotNull())
    if by_input_order:
        first = F.min(F.struct(*LINE_ORDER, F.col("seq").alias("login_seq"))).alias("r")
        firsts = logins.groupBy("session_id").agg(first).select("session_id", "r.login_seq")
    else:
        firsts = logins.groupBy("session_id").agg(F.min("seq").alias("login_seq"))
    named = logins.select("session_id", F.col("urc").alias("root_urc"), F.col("seq").alias("login_seq"))
    return firsts.join(named, ["session_id", "login_seq"]).select("session_id", "root_urc", "login_seq")


def requests(positions: DataFrame) -> DataFrame:
    """Requests that can become nodes."""
    return positions.where(
        F.col("is_request") & F.col("urc").isNotNull() & F.col("uid").isNotNull()
    ).select("session_id", "urc", "uid", "seq")


def root_nodes(roots: DataFrame) -> DataFrame:
    """Roots as nodes; they exist before the first record."""
    return roots.select(
        "session_id",
        F.col("root_urc").alias("urc"),
        F.lit(None).cast("string").alias("parent_urc"),
        F.lit(0).alias("level"),
        F.lit(-1).cast("bigint").alias("attach_seq"),
    )


def _grow(reqs: DataFrame, nodes: DataFrame, roots: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Decide every request again, given ``nodes``: the earliest whose parent exists by then wins."""
    parents = nodes.where(F.col("level") < MAX_LEVEL).select(
        "session_id", F.col("urc").alias("uid"), "level", "attach_seq"
    )
    placed = (
        join_many_to_one(reqs, parents, ["session_id", "uid"], "seq", hot)
        .where(F.col("seq") > F.col("attach_seq"))
        .select(
            "session_id",
            "urc",
            F.col("uid").alias("parent_urc"),
            (F.col("level") + 1).alias("level"),
            F.col("seq").alias("attach_seq"),
        )
    )
    return (
        placed.unionByName(roots)
        .groupBy("session_id", "urc")
        .agg(F.min(F.struct("attach_seq", "level", "parent_urc")).alias("n"))
        .select("session_id", "urc", "n.parent_urc", "n.level", "n.attach_seq")
    )


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sessions whose nodes differ."""
    keys = ["session_id", "urc", "level", "attach_seq"]
    lost, new = before.join(after, keys, "left_anti"), after.join(before, keys, "left_anti")
    return lost.select("session_id").unionByName(new.select("session_id")).distinct()


def _by_levels(reqs: DataFrame, roots: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Nodes of sessions in which every id names one parent.

    A round meets all requests with the nodes of the last level alone. An id has one parent, so it is found in that one's round
    or never, and its earliest request after the parent decides; only the root's own id can come up again.
    """
    frontier = roots.select("session_id", "urc", "level", "attach_seq")
    nodes = frontier
    for level in range(1, MAX_LEVEL + 1):
        parents = frontier.select("session_id", F.col("urc").alias("uid"), "attach_seq")
        met = join_many_to_one(reqs, parents, ["session_id", "uid"], "seq", hot).where(F.col("seq") > F.col("attach_seq"))
        found = met.groupBy("session_id", "urc").agg(F.min("seq").alias("attach_seq"))
        found = found.join(roots.select("session_id", "urc"), ["session_id", "urc"], "left_anti")
        frontier = materialise(found.select("session_id", "urc", F.lit(level).alias("level"), "attach_seq"), "level")
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier)
    # a position is one request, so its parent's id is looked up once, at the end
    named = reqs.select("session_id", F.col("seq").alias("attach_seq"), F.col("uid").alias("parent_urc"))
    return nodes.join(named, ["session_id", "attach_seq"], "left").select(*NODE)


def call_tree(
    positions: DataFrame, by_input_order: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Nodes of all sessions, written once.

    Sessions in which every id names one parent are built level by level. One in
    which an id names several parents is decided again until a round changes nothing in it:
    after n rounds every decision up to the n-th record is final, so that always ends.
    """
    reqs = materialise(requests(positions), "requests")
    roots = materialise(root_nodes(session_roots(positions, by_input_order)), "roots")
    total = positions.count()
    hot = hot_keys(reqs, ["session_id", "uid"], total, hot_rows)
    several = materialise(
        reqs.groupBy("session_id", "urc")
        .agg(F.min(F.xxhash64("uid")).alias("lo"), F.max(F.xxhash64("uid")).alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .select("session_id")
        .distinct(),
        "several_parents",
    )
    if several.isEmpty():
        return materialise(_by_levels(reqs, roots, hot), "nodes")
    big = hot_keys(reqs, ["session_id"], total, hot_rows)

    def of(rows: DataFrame, sessions: DataFrame, spread: str, how: str = "left_semi") -> DataFrame:
        return join_many_to_one(rows, sessions, ["session_id"], spread, big, how)

    simple = materialise(of(reqs, several, "seq", "left_anti"), "requests")
    done = [_by_levels(simple, roots.join(several, "session_id", "left_anti"), hot)]
    reqs, roots = materialise(of(reqs, several, "seq"), "requests"), roots.join(several, "session_id", "left_semi")
    nodes = roots
    while True:
        after = materialise(_grow(reqs, nodes, roots, hot), "nodes")
        changed = materialise(_changed(nodes, after), "changed")
        if changed.isEmpty():
            done.append(after)
            break
        # sessions are independent of one another: those without a change are final
        done.append(of(after, changed, "attach_seq", "left_anti"))
        nodes = of(after, changed, "attach_seq")
        reqs, roots = materialise(of(reqs, changed, "seq"), "requests"), roots.join(changed, "session_id", "left_semi")
    return materialise(reduce(DataFrame.unionByName, done), "nodes")


def orphans(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Request ids that never became a node."""
    return (
        positions.where(F.col("is_request") & F.col("urc").isNotNull())
        .groupBy("session_id", "urc")
        .agg(F.count(F.lit(1)).alias("n_requests"), F.min("seq").alias("first_seq"))
        .join(nodes, ["session_id", "urc"], "left_anti")
    )


def last_responses(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Position of the response each node ends up with.

    A response belongs to the node named by its ``uid``; the last one stays. Only
    the last per id is joined: if it precedes the node, so do all others.
    """
    last = (
        positions.where(F.col("is_response") & F.col("uid").isNotNull())
        .groupBy("session_id", F.col("uid").alias("urc"))
        .agg(F.max("seq").alias("seq"))
    )
    return last.join(nodes.select("session_id", "urc", "attach_seq"), ["session_id", "urc"]).where(
        F.col("seq") > F.col("attach_seq")
    ).withColumnRenamed("urc", "node_urc")


DETAIL = ["ts", "level", "service", "message", "error_type", "urc", "uid"]


def node_responses(positions: DataFrame, nodes: DataFrame, errors_only: bool = False) -> DataFrame:
    """Nodes with the record of their response; ``errors_only`` keeps ERROR and WARN ones."""
    records = positions.where("is_response")
    if errors_only:
        records = records.where(is_error_level(F.col("level")))
    return last_responses(positions, nodes).join(
        records.select("session_id", "seq", *DETAIL), ["session_id", "seq"]
    )


def node_errors(positions: DataFrame, nodes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Error records on the node named by their ``urc``, else ``uid``.

    Requests with an id and responses whose ``uid`` is a node by then are not errors.
    """
    errors = positions.where(
        F.col("error_type").isNotNull() & ~(F.col("is_request") & F.col("urc").isNotNull())
    ).select("session_id", "seq", "is_response", *DETAIL)
    total = positions.count()
    at = nodes.select("session_id", F.col("urc").alias("node_urc"), "attach_seq")

    # A response without an id of its own could only sit on its uid, which is not a node.
    responses = errors.where(F.col("is_response") & F.col("urc").isNotNull())
    parents = at.withColumnsRenamed({"node_urc": "uid"})
    hot = hot_keys(responses, ["session_id", "uid"], total, hot_rows)
    loose = (
        join_many_to_one(responses, parents, ["session_id", "uid"], "seq", hot, "left")
        .where(F.coalesce(F.col("seq") <= F.col("attach_seq"), F.lit(True)))
        .drop("attach_seq")
        .select(errors.columns)
    )
    keyed = (
        errors.where(~F.col("is_response"))
        .unionByName(loose)
        .withColumn("node_urc", F.coalesce("urc", "uid"))
        .where(F.col("node_urc").isNotNull())
    )
    hot = hot_keys(keyed, ["session_id", "node_urc"], total, hot_rows)
    return (
        join_many_to_one(keyed, at, ["session_id", "node_urc"], "seq", hot)
        .where(F.col("seq") > F.col("attach_seq"))
        .drop("is_response")
    )


def _kids(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent_urc").isNotNull()).select(
        "session_id",
        F.col("parent_urc").alias("node_urc"),
        F.col("urc").alias("child_urc"),
        "attach_seq",
    )


def children(nodes: DataFrame, size: int = LIST_ITEMS) -> DataFrame:
    """Ids of the children of each node that has any, in the order they attached; NULL beyond ``size``."""
    found = lists(_kids(nodes), ["session_id", "node_urc"], "attach_seq", F.col("child_urc"), "children", size)
    return found.withColumnRenamed("node_urc", "urc")


def children_text(nodes: DataFrame) -> DataFrame:
    """Ids of the children of each node that has any, comma-joined in the order they attached, at any number."""
    kids = _kids(nodes).groupBy("session_id", "node_urc").agg(F.sort_array(F.collect_list(F.struct("attach_seq", "child_urc"))).alias("_kids"))
    return kids.select("session_id", F.col("node_urc").alias("urc"), F.array_join("_kids.child_urc", ",").alias("children"))


def calls(nodes: DataFrame, size: int = LIST_ITEMS) -> DataFrame:
    """Per session its ``total_calls`` and ``api_calls``: every node with its children and level, in the order they attached."""
    kids = children(nodes, size).select("session_id", "urc", F.col("children").alias("kids"), "n_items")
    none = F.array().cast("array<string>")
    call = F.struct("urc", F.when(F.col("n_items").isNull(), none).otherwise(F.col("kids")).alias("children"), "level")
    found = lists(nodes.join(kids, ["session_id", "urc"], "left"), ["session_id"], "attach_seq", call, "api_calls", size)
    return found.withColumnRenamed("n_items", "total_calls")


def call_pieces(nodes: DataFrame, list_no: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The calls of each session for ``objects.write_objects``: a piece for each call and one for each child of it."""
    kids = _kids(nodes)
    at = nodes.select("session_id", F.col("urc").alias("node_urc"), "level", F.col("attach_seq").alias("node_seq"))
    keys = ["session_id", "node_urc"]
    hot = hot_keys(kids, keys, nodes.count(), hot_rows)
    first = at.select("*", F.lit(-2).cast("bigint").alias("k"), F.lit("").alias("body"))
    quoted = F.to_json(F.array("child_urc"))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    rest = join_many_to_one(kids, at, keys, "attach_seq", hot).select(*at.columns, F.col("attach_seq").alias("k"), quoted.alias("body"))
    opened = F.to_json(F.struct(F.col("node_urc").alias("urc"), "level"))
    before = F.concat(F.substring(opened, F.lit(1), F.length(opened) - 1), F.lit(',"children":['))
    return pieces(first.unionByName(rest), "session_id", list_no, "node_seq", F.col("body"), F.col("k"), before, F.lit("]}"))


def total_calls(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_calls"))
