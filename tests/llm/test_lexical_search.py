import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlogs.llm import lexical_search
from tests.llm.helpers import awkward, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=50):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    total, size = sum(n for _, _, n in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in own.items():
        scores = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * size) // total
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    return sorted((tuple(r) for r in lexical_search.search(documents(spark, docs), spark.createDataFrame(items, ITEMS), **more).collect()), key=repr)


def _corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 80)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(130)]  # more copies than places
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=25))) for i in range(12)] + [(12, docs[3][1]), (13, "W1 w2-w3"), (14, "nowhere")]
    return docs, items


@pytest.mark.parametrize("shard, width, k", [(8192, 128, 50), (60, 3, 50), (60, 1, 7)])
def test_ranks_equal_brute_force(spark, monkeypatch, shard, width, k):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "WIDTH", width)
    docs, items = _corpus(shard, 500)
    assert found(spark, docs, items, k=k) == brute(docs, items, k)


def test_blocks_of_items(spark):
    docs, items = _corpus(5, 150)
    assert found(spark, docs, items, block_terms=40) == brute(docs, items)


def test_range_maxima():
    rng = np.random.default_rng(3)
    n = 700
    docs, terms_ = np.nonzero(rng.random((n, 6)) < np.array([0.9, 0.5, 0.2, 0.05, 0.01, 0.0]))
    shard = lexical_search.Shard(docs, terms_, rng.integers(1, 9, len(docs)), n)
    for t, (a, b) in shard.lists.items():
        for _ in range(50):
            left, right = sorted(rng.integers(a, b + 1, 2).tolist())
            total, at = shard._bounds(np.array([[left]]), np.array([[right]]))
            part = shard.impacts[left:right]
            assert total[0] == (part.max() if right > left else 0), t
            assert right == left or shard.impacts[left:right][np.flatnonzero(shard.docs[left:right] == at[0])[0]] == part.max()


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    items = [(1, "a B word"), (1, "漢字"), (None, "null"), (None, "c"), (2, None), (3, ""), (4, "é")]
    df = awkward(spark).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0)).withColumn("item", F.lit(1))
    asked = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(5)).withColumn("terms", F.lit("clash"))
    assert sorted((tuple(r) for r in lexical_search.search(df, asked).collect()), key=repr) == brute(rows, items)
    assert lexical_search.search(df.limit(0), asked).count() == 0
    assert lexical_search.search(df, asked.limit(0)).count() == 0
