"""Ordering, ranking, list building and joining that do not depend on group size.

One session, source or parent may hold a large share of all rows, so nothing
here gathers a whole group in one task. A total order is made by a range-
partitioned sort; ``seq`` then carries the number of its range in its upper
bits, and every (key, range) pair is at most one sorted partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlogs.stage import materialise

# monotonically_increasing_id() keeps the partition number above bit 33.
RANGE_BITS = 33
#: Items of a list that is one value of a row; longer ones are NULL there and read from the flat tables or files.
LIST_ITEMS = 100_000
#: Items of a text that is one value; longer ones continue in further rows.
SEGMENT_ROWS = 100_000
HOT_ROWS = 1_000_000
# At most this many keys can exceed rows / MAX_HOT_KEYS, so the hot table is bounded.
MAX_HOT_KEYS = 100_000


def sequence(
    df: DataFrame,
    order: list[str],
    name: str,
    seq: str = "seq",
    then: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Add ``seq``, a BIGINT increasing along ``order`` (a unique key), and write the table.

    ``then`` adds columns after the sort, so that they are not shuffled.
    """
    ordered = df.orderBy(*order).withColumn(seq, F.monotonically_increasing_id())
    return materialise(then(ordered), name)


def ranked(df: DataFrame, keys: list[str], seq: str, rank: str) -> DataFrame:
    """Add the 1-based position of each row within ``keys``, ordered by ``seq``.

    Rows are numbered inside each (keys, range) pair and shifted by the number
    of rows in earlier ranges of the same key.
    """
    rng, before, local = "_range", "_before", "_local"
    split = df.withColumn(rng, F.shiftright(F.col(seq), RANGE_BITS))
    earlier = (
        split.groupBy(*keys, rng)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            before,
            F.sum("_n").over(
                Window.partitionBy(*keys).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .where(F.col(before) > 0)
        .select(*keys, rng, before)
    )
    numbered = split.withColumn(
        local, F.row_number().over(Window.partitionBy(*keys, rng).orderBy(seq))
    )
    return (
        numbered.join(earlier, [*keys, rng], "left")
        .withColumn(rank, F.col(local) + F.coalesce(F.col(before), F.lit(0)))
        .drop(rng, local, before)
    )


def segments(
    df: DataFrame, keys: list[str], seq: str, value: Column, name: str, size: int = SEGMENT_ROWS
) -> DataFrame:
    """Ordered lists of ``value`` per key, cut into numbered segments of ``size`` items.

    A group of up to ``size`` rows is one list, segment 0; a larger one continues
    in segments 1, 2, ... so no row or task holds more than ``size`` items.
    """
    rows = ranked(df.select(*keys, seq, value.alias("_value")), keys, seq, "_rank")
    return (
        rows.withColumn("segment_no", F.floor((F.col("_rank") - 1) / F.lit(size)))
        .groupBy(*keys, "segment_no")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "_value"))).alias("_items"))
        .select(*keys, "segment_no", F.col("_items._value").alias(name))
    )


def lists(df: DataFrame, keys: list[str], seq: str, value: Column, name: str, size: int = LIST_ITEMS) -> DataFrame:
    """One row per key: ``n_items`` and the list of ``value`` in the order of ``seq``, NULL if it has more than ``size`` items.

    Only lists within ``size`` are gathered, so no task holds a larger one.
    """
    rows = df.select(*keys, seq, value.alias("_value"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items")).where(F.col("n_items") > size)
    big = materialise(counts, "long_lists")
    some = not big.isEmpty()
    if some:
        rows = rows.join(big, keys, "left_anti")
    gathered = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(F.struct(seq, "_value"))).alias("_items"))
    found = gathered.select(*keys, "n_items", F.col("_items._value").alias(name))
    return found.unionByName(big, allowMissingColumns=True) if some else found


def hot_keys(df: DataFrame, keys: list[str], total: int, floor: int = HOT_ROWS) -> DataFrame | None:
    """Keys holding more than ``max(floor, total / MAX_HOT_KEYS)`` rows, with a fan-out each.

    ``total`` is at least the row count of ``df``, so no more than
    MAX_HOT_KEYS keys can qualify. Returns None when there are none.
    """
    limit = max(floor, total // MAX_HOT_KEYS)
    if total <= limit:
        return None
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_fan"))
    )
    hot = materialise(hot, "hot_keys")
    return None if hot.isEmpty() else hot


def join_many_to_one(
    many: DataFrame, one: DataFrame, keys: list[str], spread: str, hot: DataFrame | None, how: str = "inner"
) -> DataFrame:
    """Join ``many`` to ``one`` (unique per ``keys``), salting the keys listed in ``hot``.

    Hot rows of ``many`` are spread by a hash of ``spread``; only the matching
    rows of ``one`` are repeated, once per salt.
    """
    if hot is None:
        return many.join(one, keys, how)
    # bounded by MAX_HOT_KEYS, see hot_keys
    hot = F.broadcast(hot)
    salted = many.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.coalesce(F.col("_fan"), F.lit(1))).cast("int")
    )
    copies = one.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1))
    )
    return salted.drop("_fan").join(copies.drop("_fan"), [*keys, "_salt"], how).drop("_salt")
