import random

import pytest

import corpus_pipeline
from tests.llm.helpers import documents


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic texts, copies and test items."""
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]

    def text(n):
        return " ".join(rng.choices(vocabulary, k=n))

    items = [(k, text(40)) for k in range(8)]
    rows = [(k, text(rng.randint(30, 120)), f"s{k % 3}") for k in range(400)]
    labels = []
    for k, t, s in rows[:200]:
        toxic = int(k % 5 == 0)
        if toxic:
            words = t.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "zorgle" + rng.choice(["", "n", "st"]))
            rows[k] = (k, " ".join(words), s)
        labels.append((k, 1, toxic))
    rows += [(1000 + k, rows[201 + k][1], "s0") for k in range(10)]  # copies
    rows += [(2000 + k, f"{text(20)} {items[k][1]} {text(20)}", "s1") for k in range(8)]  # leaks
    rows += [(3000, None, None), (3001, "", "s2"), (None, text(30), "s2")]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    gone = [a - b for a, b in zip(ids, ids[1:], strict=False)]
    assert gone[0] == {k for k in range(0, 200, 5)}
    assert gone[1] == {1000 + k for k in range(10) if k + 201 in ids[1]}
    assert gone[2] == {2000 + k for k in range(8)}
    assert gone[3] < ids[3]


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert rows and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_rows_that_share_an_id(spark):
    """One row of an id stays, the same one whatever their order; rows without an id all stay."""
    texts = ["b b c d e f g", "a b c d e f g", None, "a b c d e f g"]
    rows = [(1, t, "s") for t in texts] + [(None, "x y", "s"), (None, "x y", "s"), (2, "a b c d e f g", "t")]
    found = [sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, documents(spark, r), "").collect())) for r in (rows, rows[::-1])]
    assert found[0] == found[1] and len(found[0]) == 3


def test_only_texts_of_dropped_or_repeated_ids_are_shuffled(spark):
    """Of the documents whose id has one row that is kept, the near-duplicates stage moves no text between tasks."""
    rows = [(k, " ".join(f"w{k}_{i}" for i in range(20)), "s") for k in range(300)]
    rows += [(1000, rows[7][1], "s"), (8, None, "s"), (8, rows[3][1], "t"), (None, rows[5][1], "s"), (None, None, "s")]
    out = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows).repartition(3), "")
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert {k for k, _ in got} == {*range(300), None} and (1000, rows[7][1]) not in got and (None, rows[5][1]) in got
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    union = next(k for k, line in enumerate(plan) if "Union" in line)
    first = next(line for line in plan[union + 1 :] if "Join" in line)
    assert "_piece" in first, first  # a broadcast of bits, not a join by id
