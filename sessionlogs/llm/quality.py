"""Quality rules: a threshold table compiled into one projection of built-in functions.

``FEATURES`` are expressions of a text's ratios, ``THRESHOLDS`` names the bounds. ``apply`` turns
both into one Spark projection; nothing is shuffled and no user function runs.

Words are runs of characters other than space and U+0009 to U+000D. Defined cases: a NULL text
counts as empty; an empty text has no words, ratios of 0, and fails on its length. Texts of any
length are read whole: every step is linear or sorts. Columns of the input are kept; of clashing
names the computed one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent short words of four languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for was as on are by this from or an at "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur avec "
    "el que y los se del las por con no una su para es al lo como"
).split()

#: feature, least, most (None: no bound). Of any text that a rule doesn't fit, the rule's name is reported.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("repeat_ratio", None, 0.30),
    ("mean_word_chars", 2, 14),
    ("symbol_ratio", None, 0.30),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.30),
)

#: The rules of the fixed base verdict.
BASE_RULES = ("n_words", "repeat_ratio")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row: a lambda's variable isn't computed again."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(hashes: Column, n: Column) -> Column:
    """Words in windows of eight that stand twice or more, compared by 64-bit hashes.

    Only texts in which some window repeats sort their windows; then the starts of repeated windows,
    in order, cover eight words each, less the overlap with the next.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(F.slice(starts, F.lit(2), F.size(starts)), lambda p, i: F.least(F.lit(WINDOW), p - F.get(starts, i)))
        return F.aggregate(steps, F.lit(WINDOW), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        same = F.filter(
            F.transform(ordered, lambda x, i: F.when((x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]), x["i"])),
            lambda p: p.isNotNull(),
        )
        return F.sort_array(same)

    def counted(windows: Column) -> Column:
        places = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            bound(bound(places, repeated), covered),
        ).otherwise(0)

    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
    return F.when(n >= WINDOW, bound(windows, counted)).otherwise(0).cast("bigint")


def counts(text: Column) -> Column:
    """The counts of one text as a struct."""
    text = F.coalesce(text, F.lit(""))

    def of(ws: Column) -> Column:
        n = F.size(ws)
        return F.struct(
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            n_dup_lines(text).alias("n_dup_lines"),
            F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("bigint").alias("n_lines"),
            bound(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: n_repeat_words(hs, n)).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        )

    return bound(words(text), of)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def ratios() -> dict[str, Column]:
    return {
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "stop_ratio": _ratio("n_stop_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
    }


def _fails(name: str, least: float | None, most: float | None) -> Column:
    bounds = [F.col(name) < least] if least is not None else []
    bounds += [F.col(name) > most] if most is not None else []
    return F.coalesce(bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1], F.lit(False))


def apply(df: DataFrame, text: str = "text", thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """Adds the counts, the ratios, ``failed_rules`` (names in table order) and ``kept``."""
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words")
    out = df.withColumn("_counts", counts(F.col(text)))
    out = out.withColumns({f: F.col(f"_counts.{f}") for f in fields}).drop("_counts").withColumns(ratios())
    failed = F.filter(F.array(*(F.when(_fails(*t), F.lit(t[0])) for t in thresholds)), lambda x: x.isNotNull())
    return out.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)
