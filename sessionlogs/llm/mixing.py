"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, rows are range-sorted by the key and their
sizes summed from the start; the source's budget cuts that order at an exact size. A budget over the
source's whole size repeats the order in further epochs.

The prefix sums are distributed: a source's keys are split into equal ranges, as many as its rows need
(keys are uniform, so ranges hold about equal numbers and a hot source merely has more of them).
Sums by range are prefix-summed in a small table, and rows are summed within their range only.

Defined cases: a NULL source is one more source, last in order; a NULL text has size 0; rows of size 0
are kept by the order but take nothing. Equal ids, and whole rows that repeat, are told apart by their text and, where
that is equal too, are interchangeable. Extra columns are kept; of clashing names the computed
one stays. An empty table gives an empty result.
A rerun gives the same rows: keys are 60 bits of the MD5 of id and seed (of the text for a NULL id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlogs.stage import materialise

#: Rows aimed at in a range of keys.
RANGE_ROWS = 2_000
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST_EPOCHS = 3
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    trimmed = F.trim(blank)
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.translate(trimmed, " ", "")) + 1).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source (``source``, ``source_size``) with its ``target``.

    Sources in code-point order, NULL last, weigh ``weights`` in turn and share the total. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight until none is above. That has one solution:
    sources by rising limit per weight; the first whose fair share of the rest is within its limit ends the limited ones.
    The table has a row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    df = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    df = df.withColumn("_limit", F.col("source_size") * most)
    by_limit = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    df = df.withColumns(
        {
            "_rest": F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0)),
            "_rest_w": F.sum("_w").over(after),
            "_place": F.row_number().over(by_limit),
        }
    )
    fair = (F.col("_rest") * F.col("_w")).cast("double") / F.col("_rest_w")
    df = df.withColumn("_open", fair <= F.col("_limit"))
    first = F.min(F.when(F.col("_open"), F.struct("_place", "_rest", "_rest_w"))).over(whole)
    df = df.withColumn("_first", first)
    share = (F.col("_first._rest") * F.col("_w")).cast("double") / F.col("_first._rest_w")
    target = F.when(F.col("_place") < F.coalesce(F.col("_first._place"), F.lit(2**31 - 1)), F.col("_limit").cast("double")).otherwise(share)
    return df.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame, size: Column, source: str = "source", doc_id: str = "doc_id", text: str = "text", *,
    weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 42,
) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``start`` (size of the source before the row) and ``taken``.

    A source's ``taken`` add up to its target rounded to a whole number. ``text`` only breaks ties; a hash of the text will do.
    """
    named = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.col(text).cast("string")), F.lit(seed))
    key = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("bigint")
    rows = df.drop("source_size", "target", "start", "taken").withColumns({"size": size, "_key": key, "_source": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit(""))})
    part = F.shiftright(F.col("_key"), 44)
    fine = rows.groupBy(F.col(source).alias("source"), "_source", part.alias("_part")).agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    fine = materialise(fine, "mix_ranges")
    sources = fine.groupBy("source", "_source").agg(F.sum("_sum").alias("source_size"), F.sum("_n").alias("_n"))
    bits = F.least(F.lit(16), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / RANGE_ROWS)))).cast("int")
    plan = targets(sources.select("source", "source_size"), weights, most)
    plan = plan.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    plan = plan.join(sources.select("_source", bits.alias("_bits")), "_source")
    ranges = fine.join(plan.select("_source", "_bits"), "_source")
    ranges = ranges.groupBy("_source", F.expr("shiftright(_part, 16 - _bits)").alias("_range")).agg(F.sum("_sum").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_source", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    plan = materialise(plan.join(ranges, "_source"), "mix_plan")
    bits_of = plan.select("_source", "_bits").distinct()
    # a row per source, and a row per source and range: Spark broadcasts them while they are small
    rows = rows.join(bits_of, "_source").withColumn("_range", F.shiftright(F.col("_key"), 44))
    rows = rows.withColumn("_range", F.expr("shiftright(_range, 16 - _bits)")).drop("_bits")
    within = Window.partitionBy("_source", "_range").orderBy("_key", doc_id, text)
    rows = rows.withColumn("_sum", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(plan.drop("_bits"), ["_source", "_range"])
    budget = F.round("target").cast("bigint")
    rows = rows.withColumn("start", F.col("_offset") + F.col("_sum"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.least(F.col("size"), F.greatest(F.lit(0), budget - epochs * F.col("source_size") - F.col("start")))
    rows = rows.withColumn("taken", F.coalesce(epochs * F.col("size") + rest, F.lit(0)))
    return rows.drop("_source", "_range", "_key", "_sum", "_offset")


def epochs_of(df: DataFrame) -> DataFrame:
    """Rows of a mix as training text: each row once for every epoch in which some of it is taken, whole."""
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(F.col("epoch") <= times)
