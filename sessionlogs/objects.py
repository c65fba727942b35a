"""JSON objects of any size, written from rows that each hold a piece of one.

An object is a row of ``marks``, the texts before, between and after its lists, and a row for each piece of a list.
Pieces are put in order by a sort within the object's task, commas and brackets come from their neighbours there, and the text writer puts
them one after another: no object is ever one row, so its size is bound by disk, not memory.

Every line of the files is one JSON object. An object with more than PART_PIECES pieces continues in further lines, which repeat
the marks and carry their number as ``part``, so that no key's pieces meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlogs.skew import ranked, sequence
from sessionlogs.stage import materialise

PART_PIECES = 1_000_000
#: Stands between two pieces in the files: white space that JSON allows there.
GAP = " "


def opened(value: Column) -> Column:
    """A struct as a JSON object whose end is left open for more fields."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(1), F.length(text) - 1)


def item(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def pieces(rows: DataFrame, key: str, list_no: int, n: str, body: Column, k: Column | None = None, before: Column | None = None, after: Column | None = None) -> DataFrame:
    """Pieces of the list ``list_no``, in the order of ``n``, then ``k``.

    Pieces with one ``n`` are the inside of one list item, which begins with ``before`` and ends with ``after``; an empty
    ``body`` only makes sure that it exists.
    """
    nothing = F.lit("")
    return rows.select(
        key, F.lit(2 * list_no + 1).alias("place"), F.col(n).alias("n"), (F.lit(0).cast("bigint") if k is None else k).alias("k"),
        (nothing if before is None else before).alias("before"), body.alias("body"), (nothing if after is None else after).alias("after"),
    )


def _in_parts(items: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Pieces with the number of their part; keys with several parts, if there are any."""
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    big = materialise(counts.select(key, F.ceil(F.col("_n") / F.lit(most)).alias("parts")), "objects_in_parts")
    if big.isEmpty():
        return items.withColumn("part", F.lit(0).cast("bigint")), None
    # each has more than ``most`` pieces, so they are few
    large = items.join(big, key, "left_semi")
    ordered = sequence(large, [key, "place", "n", "k"], "object_pieces", "_at")
    large = ranked(ordered, [key], "_at", "_rank").withColumn("part", F.floor((F.col("_rank") - 1) / F.lit(most)))
    small = items.join(big, key, "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    return small.unionByName(large.drop("_at", "_rank")), big


def write_objects(marks: DataFrame, items: DataFrame, key: str, path: str, most: int = PART_PIECES, folders: bool = False) -> None:
    """Append one JSON object per row of ``marks`` (``key``, ``marks``, an array of texts) to the files below ``path``.

    ``folders`` gives each key a folder of its own, which suits few keys; one for each of millions does not.
    """
    items, big = _in_parts(items, key, most)
    marks = marks.select(key, "marks")
    if big is not None:
        marks = marks.join(big, key, "left")
    parts = F.lit(1).cast("bigint") if big is None else F.coalesce("parts", F.lit(1))
    marks = marks.select(key, "marks", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    marks = marks.select(key, "part", "parts", F.size("marks").alias("n_marks"), F.posexplode("marks").alias("at", "body"))
    named = F.concat(F.lit('{"part":'), F.col("part").cast("string"), F.lit(","), F.substring("body", 2, 2**31 - 1))
    text = F.when((F.col("at") == 0) & (F.col("parts") > 1), named).otherwise(F.col("body"))
    text = F.concat(text, F.when(F.col("at") == F.col("n_marks") - 1, F.lit("\n")).otherwise(F.lit("")))
    zero = F.lit(0).cast("bigint")
    marks = marks.select(key, "part", (2 * F.col("at")).alias("place"), zero.alias("n"), zero.alias("k"), F.lit("").alias("before"), text.alias("body"), F.lit("").alias("after"))
    order = Window.partitionBy(key, "part").orderBy("place", "n", "k")
    in_list = F.col("place") % 2 == 1
    last, next_ = F.lag(F.struct("place", "n", "body")).over(order), F.lead(F.struct("place", "n")).over(order)
    follows = in_list & (last["place"] == F.col("place"))
    within = follows & (last["n"] == F.col("n"))
    goes_on = in_list & (next_["place"] == F.col("place")) & (next_["n"] == F.col("n"))
    start = F.when(within, F.when(last["body"] != "", ",").otherwise("")).when(follows, F.concat(F.lit(","), F.col("before"))).otherwise(F.col("before"))
    end = F.when(goes_on, "").otherwise(F.col("after"))
    rows = marks.unionByName(items).select(key, F.concat(start, "body", end).alias("text")).where("text <> ''")
    writer = (rows if folders else rows.select("text")).write.mode("append").option("lineSep", GAP)
    (writer.partitionBy(key) if folders else writer).text(path)
