import random

import numpy as np
from pyspark.sql import functions as F

from sessionlogs.llm import decontaminate
from tests.llm.helpers import awkward, documents

ITEMS = "item_id long, text string"


def brute(text, item):
    """Smith-Waterman by the textbook."""
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_textbook():
    rng = random.Random(2)
    for _ in range(200):
        text, item = ([rng.randint(1, 4) for _ in range(rng.randint(1, 25))] for _ in range(2))
        score, start, end = decontaminate.align(np.array(text), np.array(item))
        assert score == brute(text, item)
        assert brute(text[start:end], item) == score


def test_exact_and_edited_copies_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(20)]

    def edited(text, share):
        out = []
        for w in text.split():
            kind = rng.random()
            if kind < share / 3:
                continue
            out.append(rng.choice(vocabulary) if kind < 2 * share / 3 else w)
            if 2 * share / 3 <= kind < share:
                out.append(rng.choice(vocabulary))
        return " ".join(out)

    rows, want = [], set()
    for k in range(200):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(20, 300)))
        if k % 4 == 0:
            i = k % 20
            text += ". " + edited(items[i][1], 0.0 if k % 8 else 0.12).upper() + "! " + " ".join(rng.choices(vocabulary, k=50))
            want.add((k, i))
        rows.append((k, text))
    out = decontaminate.mark(documents(spark, rows), spark.createDataFrame(items, ITEMS))
    assert {(r.doc_id, h.item_id) for r in out.collect() for h in r.hits} == want


def test_copies_edited_down_to_the_least_score(spark):
    rng = random.Random(5)
    items = [(i, [f"i{i}w{j}" for j in range(size)]) for i, size in enumerate([16, 16, 12, 40, 40, 59] * 4)]
    texts = []
    for _, item in items:
        for share in (0.12, 0.16, 0.2, 0.23, 0.25):
            text = list(item)
            for j in rng.sample(range(len(item)), int(share * len(item))):
                text[j] = f"z{rng.randint(1, 999)}"
            texts.append(["before"] * 3 + text + ["after"] * 3)
    want = {(k, i) for k, t in enumerate(texts) for i, item in items if brute(t, item) >= 0.5 * len(item)}
    out = decontaminate.mark(documents(spark, [(k, " ".join(t)) for k, t in enumerate(texts)]), spark.createDataFrame([(i, " ".join(t)) for i, t in items], ITEMS))
    assert {(r.doc_id, h.item_id) for r in out.collect() for h in r.hits} == want
    assert len(want) == len(texts)


def found(spark, texts, items, **more):
    out = decontaminate.mark(documents(spark, list(enumerate(texts))), spark.createDataFrame(items, ITEMS), **more)
    return {(r.doc_id, h.item_id): (round(h.score, 6), h.start, h.end) for r in out.collect() for h in r.hits}


def test_any_edits_equal_brute_force(spark):
    """Substitutions, insertions and deletions at all scores, of words that are shared by items and texts."""
    rng = random.Random(11)
    common = [f"c{j}" for j in range(25)]
    items = [[rng.choice(common) if rng.random() < 0.5 else f"i{i}w{j}" for j in range(size)] for i, size in enumerate([5, 6, 7, 10, 16, 16, 30, 30, 59])]
    texts = []
    for item in items:
        for kind in ("substitute", "insert", "delete", "any") * 6:
            text, share = [], rng.uniform(0.1, 0.6)
            for w in item:
                what = kind if kind != "any" else rng.choice(("substitute", "insert", "delete"))
                if rng.random() >= share:
                    text.append(w)
                elif what == "insert":
                    text += [w, rng.choice(common)]
                elif what == "substitute":
                    text.append(rng.choice(common))
            texts.append(rng.choices(common, k=rng.randint(0, 40)) + text + rng.choices(common, k=rng.randint(0, 40)))
        texts.append([w for pair in zip(item, ["between"] * len(item), strict=True) for w in pair][:-1])
        texts.append([x for j, w in enumerate(item) for x in ([w, "added"] if j % 2 else [w])])
    want = {(k, i): brute(t, item) / len(item) for k, t in enumerate(texts) for i, item in enumerate(items)}
    want = {at: round(score, 6) for at, score in want.items() if score >= 0.5}
    got = found(spark, [" ".join(t) for t in texts], [(i, " ".join(t)) for i, t in enumerate(items)])
    assert {at: score for at, (score, _, _) in got.items()} == want
    assert len(want) > 100 and min(want.values()) < 0.55


def test_a_word_added_after_every_second_one(spark):
    item = [f"w{j}" for j in range(30)]
    text = " ".join(w + " added" if j % 2 else w for j, w in enumerate(item))
    assert found(spark, [text], [(1, " ".join(item))]) == {(0, 1): (round(16 / 30, 6), 0, 44)}


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "only three words"), (2, "你好世界这是一个测试问题"), (3, "single"), (4, "")]
    texts = ["Here: only THREE words!", "only two three words, single", "前文你好世界这是一个测验问题后文", "世界和平"]
    got = found(spark, texts, items)
    assert got[(0, 1)] == (1.0, 1, 4) and got[(2, 2)] == (round(10 / 12, 6), 2, 14) and set(got) == {(0, 1), (2, 2)}


def test_widespread_and_equal_items_and_crowded_bits(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(6)] + [(7, " ".join(f"i0w{j}" for j in range(12))), (10, None), (None, "one two three four five six")]
    rows = [f"start {items[0][1]} end"] * 50 + [items[5][1] + " " + items[3][1], "x one two three four five six"]
    want = {**{(k, i): (1.0, 1, 13) for k in range(50) for i in (0, 7)}, (50, 3): (1.0, 12, 24), (50, 5): (1.0, 0, 12), (51, None): (1.0, 1, 7)}
    for bits in (7, 26):
        monkeypatch.setattr(decontaminate, "BITS", bits)
        assert found(spark, rows, items) == want


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("hits", F.lit("clash"))
    items = spark.createDataFrame([(1, "word " * 30)], ITEMS)
    out = {r.doc_id: len(r.hits) for r in decontaminate.mark(df, items).collect()}
    assert out == {1: 0, 2: 0, 3: 1, 4: 0, None: 0, 5: 0, 6: 0}
    assert {len(r.hits) for r in decontaminate.mark(df, items.limit(0)).collect()} == {0}
    assert decontaminate.mark(df.limit(0), items).count() == 0
