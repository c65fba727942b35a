import random

from pyspark.sql import functions as F

from sessionlogs.llm import toxicity
from tests.llm.helpers import awkward, documents


def _corpus(n):
    rng = random.Random(5)
    plain = ["".join(rng.choice("abdeiklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        words = rng.choices(plain, k=80)
        if k % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(80), "zurlo" + rng.choice(["", "na", "nita", "mes"]))
        rows.append((k, " ".join(words) + "."))
        labels.append((k, 1, int(k % 4 == 0)))
    return rows, labels


def test_learned_insults_on_held_out_rows(spark):
    rows, labels = _corpus(800)
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.add_score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    right = out.where((F.col("score") >= 0.3) == (F.col("toxic") == 1)).count()
    assert right >= 0.98 * out.count() > 100


def test_patterns_weigh_matched_clauses():
    model = toxicity.Model({"fool$": 2.0})

    def total(text):
        return toxicity.measures(text, toxicity.Lexicon(model.entries), toxicity.Machine())[0]

    assert total("a fool walks") == 2.0
    assert total("you are a fool") == 2.5
    assert total("he is not a fool") == 2.5 * 0.5
    assert total('he said "fool" and left') == 2.5 * 0.6
    assert total("you said. a fool walks") == 2.0  # a clause's end forgets
    assert total("not one of them here is any fool") == 2.5  # beyond the negation's reach
    assert total("we will kill you") == toxicity.THREAT_WEIGHT * 1.25
    assert total("the show will kill time") == 0
    assert total("") == 0


def test_awkward_rows_and_no_labels(spark):
    df = awkward(spark).withColumn("score", F.lit("clash")).withColumn("n_clauses", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(4, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")):
        model = toxicity.fit(df, labels)
        rows = toxicity.add_score(df, model).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.add_score(df.limit(0), model).count() == 0
