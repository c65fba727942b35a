import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sessionlogs.llm import language_id
from sessionlogs.llm.queries import op11_language_id
from tests.llm.helpers import DOCS, awkward, documents

SYLLABLES = {"aa": "the ing tion er wh ou", "bb": "die ung keit sch ein ä", "cc": "eau que é oi tre ment", "漢": "の は 漢字 です した 語"}


def _rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(rng.randint(4, 60))]
        rows.append((k, " ".join(words).capitalize() + ".", lang, "s", 0))
    return rows


def test_held_out_accuracy_and_labels_are_no_input(spark, tmp_path):
    rows = _rows(600)
    rows[5] = (5, None, "aa", "s", 0)
    rows[6] = (6, "1234 + 56²", "bb", "s", 0)
    right = {r[0]: r[2] for r in rows}
    hidden = [r if zlib.crc32(str(r[0]).encode()) % 4 != 2 else (r[0], r[1], "zz", "t", 0) for r in rows]
    spark.createDataFrame(hidden, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_language_id(spark, str(tmp_path)).collect()
    assert len(out) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    tested = [r for r in out if r.held_out and r.doc_id not in (5, 6)]
    assert len(tested) > 100 and sum(r.lang_pred == right[r.doc_id] for r in tested) >= 0.99 * len(tested)
    assert all(0 <= r.score <= 1 for r in out)
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (5, 6)} == {("und", 0.0)}


def test_profile_is_the_sum_of_bound_letters():
    text = "Ab, b"
    letters = [language_id.letter_vector(ord(c)).astype(int) for c in " ab b "]
    want = sum(np.roll(letters[i], 2) * np.roll(letters[i + 1], 1) * letters[i + 2] for i in range(4))
    assert language_id.Profiles().of(text).tolist() == want.tolist()
    assert language_id.Profiles().of("12 ²½ !") is None


def test_blocks_and_forgotten_letters_change_nothing(monkeypatch):
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    want = language_id.Profiles().of(text)
    monkeypatch.setattr(language_id, "BLOCK", 100)
    monkeypatch.setattr(language_id, "MEMORY", 50)
    few = language_id.Profiles()
    assert few.of(text).tolist() == want.tolist() and few.of(text).tolist() == want.tolist()


def test_bounded_sample_of_each_language(spark):
    docs = spark.createDataFrame(_rows(400, seed=8), DOCS)
    few = language_id.fit(docs, rows=15)
    assert few.names == sorted(SYLLABLES)
    out = language_id.add_language(docs, few).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_awkward_rows_and_nothing_to_learn(spark):
    df = awkward(spark).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("clash")).withColumn("_lang", F.lit("x"))
    nothing = language_id.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language_id.add_language(df, nothing).collect()} == {("und", 0.0)}
    one = language_id.fit(df)
    out = {(r.doc_id, r.text): r.lang_pred for r in language_id.add_language(df, one).collect()}
    assert out[(1, None)] == out[(2, "")] == out[(5, " \n\t ")] == "und" and out[(4, "a b c")] == "en"
    assert language_id.add_language(df, one).count() == 8 and language_id.add_language(df.limit(0), one).count() == 0
    assert language_id.fit(documents(spark, [])).names == []
