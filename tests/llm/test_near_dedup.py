import random
import re
from math import ceil, comb

import pytest
from pyspark.sql import functions as F

from sessionlogs.llm import near_dedup
from tests.llm.helpers import awkward, documents


def brute(rows, size):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(spark, rows, size):
    out = near_dedup.groups(documents(spark, rows), shingle=size).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def _copy(rng, words, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("size", [2, 5])
def test_groups_of_all_sizes(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for group in (1, 1, 1, 2, 3, 10, 40, 90):
        base = rng.choices(vocabulary, k=rng.randint(5, 160))
        texts += [_copy(rng, base, rng.choice([0, 0.01, 0.03, 0.06]), vocabulary) for _ in range(group)]
    shared = rng.choices(vocabulary, k=60)  # a passage that many share
    texts += [shared + rng.choices(vocabulary, k=rng.randint(10, 60)) for _ in range(80)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(spark, rows, size) == brute(rows, size)


def test_many_short_texts_over_a_small_vocabulary(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(6)]
    texts = [rng.choices(vocabulary, k=rng.randint(5, 12)) for _ in range(900)]
    texts += [t + [rng.choice(vocabulary)] for t in texts[:200]]
    texts += [["w0", "w1", "w2", "w3", "w4", "w5", f"x{i}"] for i in range(90)]  # one frequent beginning, no links
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_few_linked_pairs_are_dropped_by_their_estimate():
    dropped = ceil(near_dedup.LEAST_ESTIMATE * near_dedup.K)
    p = near_dedup.SIMILAR / 100
    assert sum(comb(near_dedup.K, i) * p**i * (1 - p) ** (near_dedup.K - i) for i in range(dropped)) < 1e-6


def test_small_sets_and_thresholds(spark):
    base = "a b c d e f g h i j k"  # ten 2-word shingles
    rows = [(1, base), (2, base + " l"), (3, base + " l m"), (4, base + " l m n"), (5, "one"), (6, "ONE"), (7, "one two"), (8, "x y"), (9, "a b c d e f g h i j k l m n o p")]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(0))
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.groups(df).collect()}
    assert out[(1, 0)] == (1, True) and out[(2, 0)] == (2, True) and out[(5, 0)] == (5, True)
    assert out[(3, 1)] == (3, True) and out[(4, 2)] == (4, True) and out[(None, 1)] == (None, True)
    assert near_dedup.groups(df).count() == 8
    assert near_dedup.groups(df.limit(0)).count() == 0


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = {r.id: r.component for r in near_dedup.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_filter_keeps_every_wanted_row(spark):
    rows = spark.range(-2000, 3000).select("id", F.lit("t").alias("text")).unionByName(spark.createDataFrame([(None, "t")], "id long, text string"))
    wanted = spark.range(-2000, 3000, 7)
    found = {r.id for r in near_dedup._perhaps_in(rows, wanted).collect()}
    assert found >= {r.id for r in wanted.collect()} and len(found) < 900
    assert near_dedup._perhaps_in(rows, wanted.limit(0)).count() == 0


def test_large_groups_near_the_threshold(spark):
    """Groups beyond a list's length whose similarities lie around 0.8: of the merges that brute force makes, one in a hundred may be missed."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for rate in (0.04, 0.05, 0.06):
        base = rng.choices(vocabulary, k=rng.randint(100, 180))
        texts += [_copy(rng, base, rate, vocabulary) for _ in range(150)]
    base = rng.choices(vocabulary, k=150)
    middle = [_copy(rng, base, 0.05, vocabulary) for _ in range(8)]
    texts += [_copy(rng, rng.choice(middle), rng.random() * 0.04, vocabulary) for _ in range(150)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want, got = ({c for _, c in x.values()} for x in (brute(rows, 2), found(spark, rows, 2)))
    assert want <= got and len(got) - len(want) <= 0.01 * (len(rows) - len(want))
    assert len(want) < 0.6 * len(rows)  # not vacuous


def test_lists_longer_than_every_cap_lose_no_link(spark, monkeypatch):
    """The groups of all sizes with lists long beyond two members: long lists, however long, lose no link."""
    monkeypatch.setattr(near_dedup, "LIST", 2)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for group in (1, 1, 1, 2, 3, 10, 40, 90):
        base = rng.choices(vocabulary, k=rng.randint(5, 160))
        texts += [_copy(rng, base, rng.choice([0, 0.01, 0.03, 0.06]), vocabulary) for _ in range(group)]
    shared = rng.choices(vocabulary, k=60)  # a passage that many share
    texts += [shared + rng.choices(vocabulary, k=rng.randint(10, 60)) for _ in range(80)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_long_prefix_lists_with_few_outside_their_largest_component_go_no_deeper(spark, monkeypatch):
    """A long prefix list whose members but LIST lie in one component gives its pairs at once: its members' keys of the
    next level, which grow as the square of their prefixes, are not written."""
    monkeypatch.setattr(near_dedup, "LIST", 2)
    written = []
    real = near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, name: written.append(name) or real(df, name))
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=60)
    texts = [_copy(rng, base, 0.03, vocabulary) for _ in range(12)] + [_copy(rng, base, 0.15, vocabulary)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(spark, rows, 2) == brute(rows, 2)
    assert written.count("prefix_lists") == 3


def _near_misses(rng, copies):
    """Copies of one text whose similarities lie below the threshold, so that no link makes them one component, and a few linked ones."""
    base = [f"w{i}" for i in range(120)]
    edits = [{*rng.sample(range(120), 5)} for _ in range(copies)]
    texts = [[f"x{k}_{i}" if i in own else w for i, w in enumerate(base)] for k, own in enumerate(edits)]
    return [(i, " ".join(t)) for i, t in enumerate(texts + [[*t, "end"] for t in texts[:5]])]


def test_rows_of_long_lists_grow_with_the_texts_not_with_their_pairs(spark, monkeypatch):
    """No table that is written for a group of near misses has a row for each pair, or for each choice of several shared values."""
    rows = _near_misses(random.Random(3), 90)
    written = []
    real = near_dedup.materialise

    def counted(df, name):
        out = real(df, name)
        written.append((out.count(), name))
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    want = brute(rows, 2)
    assert found(spark, rows, 2) == want
    shingles = sum(n for n, _ in want.values())
    assert max(written)[0] <= shingles, max(written)


def test_blocks_of_a_long_list_hold_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 1500)
    rows = _near_misses(random.Random(4), 60)
    assert found(spark, rows, 2) == brute(rows, 2)


@pytest.mark.parametrize("cells", [300, 5000, 1 << 20])
def test_linked_joins_what_all_pairs_of_a_block_join(monkeypatch, cells):
    monkeypatch.setattr(near_dedup, "CELLS", cells)
    rng = random.Random(cells)
    base = rng.sample(range(1000), 40)
    sets = [sorted({rng.randrange(1000, 3000) if rng.random() < 0.07 else v for v in base}) for _ in range(60)] + [[]]
    part, component = [rng.randrange(2) for _ in sets], [rng.randrange(40) for _ in sets]
    columns = {"part": part, "cid": range(len(sets)), "component": component, "n": map(len, sets), "items": sets}
    block = near_dedup.pa.table({"i": [0] * len(sets), "j": [1] * len(sets)} | {k: list(v) for k, v in columns.items()})

    def joined(pairs):
        parent = {c: c for c in component}

        def root(x):
            return x if parent[x] == x else root(parent[x])

        for a, b in pairs:
            parent[root(component[a])] = root(component[b])
        return {frozenset(c for c in parent if root(c) == r) for r in map(root, parent)}

    def linked(a, b):
        return sets[a] and sets[b] and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})

    every = [(a, b) for b in range(len(sets)) for a in range(b) if part[a] != part[b] and linked(a, b)]
    got = [(r["a"], r["b"]) for r in near_dedup._linked(block).to_pylist()]
    assert {*got} <= {*every} and joined(got) == joined(every) and len(got) == len({*component}) - len(joined(every))


def test_filter_parts_the_rows(spark):
    rows = spark.range(-500, 500).unionByName(spark.createDataFrame([(None,)], "id long")).selectExpr("id as k")
    ids = spark.range(-500, 500, 9).selectExpr("id as k")
    inside, outside = ([r.k for r in near_dedup.perhaps_in(rows, ids, "k", inside=x).collect()] for x in (True, False))
    assert sorted(map(str, inside + outside)) == sorted(map(str, [*range(-500, 500), None]))
    assert not {*outside} & {*range(-500, 500, 9)}
    assert near_dedup.perhaps_in(rows, ids.limit(0), "k", inside=False).count() == 1001


def test_filter_takes_ids_of_any_type(spark):
    rows, ids = (spark.range(n).selectExpr("sha2(string(id), 256) as k") for n in (50, 5))
    assert near_dedup.perhaps_in(rows, ids, "k").join(ids, "k").count() == 5
    assert near_dedup.perhaps_in(rows, ids, "k", inside=False).join(ids, "k").count() == 0
