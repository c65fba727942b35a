import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sessionlogs.llm import quality
from tests.llm.helpers import LONG, awkward, documents


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(["a", "bb", "ç", "\U0001f600", "#", " ", " ", " ", "\n", "\t", "\u00a0", "\x0b", "\x1c"], k=rng.randint(0, 300))) for _ in range(150)]
    texts += [None, "", " ", "a " * 9, "a b c d e f g h a b c d e f g h", "x\nx\n \nx", LONG, "the " * 30 + "| # $ % " * 20]
    out = quality.apply(documents(spark, list(enumerate(texts))).withColumn("kept", F.lit("clash")).withColumn("n_lines", F.lit("clash")))
    rows = {r.doc_id: r for r in out.collect()}
    for k, text in enumerate(texts):
        assert tuple(rows[k][f] for f in FIELDS) == brute(text), text


def test_rules_are_one_projection(spark):
    df = documents(spark, [(1, "a")])
    plan = quality.apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_awkward_rows_and_thresholds(spark):
    out = quality.apply(awkward(spark), thresholds=[("n_words", 2, 3)])
    assert sorted((r.doc_id or 0, r.kept, tuple(r.failed_rules)) for r in out.collect()) == sorted(
        [(1, False, ("n_words",)), (2, False, ("n_words",)), (3, False, ("n_words",)), (4, True, ()), (4, True, ()), (0, True, ()), (5, False, ("n_words",)), (6, False, ("n_words",))]
    )
    assert quality.apply(awkward(spark).limit(0)).count() == 0
