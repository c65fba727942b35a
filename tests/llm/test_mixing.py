import random
from fractions import Fraction

from pyspark.sql import functions as F

from sessionlogs.llm import mixing
from tests.llm.helpers import awkward, documents


def brute_targets(sizes):
    """Reshares the excess by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        rest = Fraction(total - sum(target.values()))
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = Fraction(3 * sizes[s])
        open_ -= above
    return target


def rows_of(rng, sizes):
    out = []
    for source, total in sizes.items():
        while total:
            n = min(total, rng.randint(0, 30))
            out.append((len(out), " ".join("w" * n), source))
            total -= n
    return out


def test_budgets_and_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(1)
    for sizes in ({"a": 900, "b": 10, "c": 400, None: 90, "é": 3}, {"only": 50}, {"x": 1000, "y": 1, "z": 1}, {"x": 0, "y": 5}):
        df = documents(spark, rows_of(rng, sizes) + [(10_000, "", "zero")])
        sizes = {**sizes, "zero": 0}
        sizes = {s: n for s, n in sizes.items() if n or s == "zero"}
        out = mixing.mix(df, mixing.n_words(F.col("text"))).collect()
        assert len(out) == df.count()
        want = brute_targets(sizes)
        for source, size in sizes.items():
            own = [r for r in out if r.source == source]
            assert {r.source_size for r in own} == {size}
            assert all(abs(r.target - float(want[source])) < 1e-6 for r in own)
            assert abs(sum(r.taken for r in own) - float(want[source])) <= 0.5
            assert all(0 <= r.taken <= 3 * r.size for r in own)
            # in one order of the source, full copies come first and at most one row is cut
            own.sort(key=lambda r: r.start)
            assert [r.start for r in own] == [sum(x.size for x in own[:k]) for k in range(len(own))]
            assert sum(r.size > 0 and r.taken % r.size > 0 for r in own) <= 1


def test_reruns_and_partitions_agree(spark):
    df = documents(spark, rows_of(random.Random(2), {"a": 2000, "b": 50}))
    first = sorted((r.doc_id, r.taken) for r in mixing.mix(df, mixing.n_words(F.col("text"))).collect())
    assert first == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(5), mixing.n_words(F.col("text"))).collect())


def test_epochs_are_whole_rows(spark):
    df = spark.createDataFrame([(1, 10, 25), (2, 10, 10), (3, 10, 0), (4, 0, 0), (5, 10, 3)], "doc_id long, size long, taken long")
    assert sorted((r.doc_id, r.epoch) for r in mixing.epochs_of(df).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (5, 1)]


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("taken", F.lit("clash")).withColumn("target", F.lit("clash"))
    out = mixing.mix(df, mixing.n_words(F.col("text"))).collect()
    assert len(out) == 8 and sum(r.taken for r in out) > 0
    assert mixing.mix(df.limit(0), mixing.n_words(F.col("text"))).count() == 0
